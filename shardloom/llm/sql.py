"""DuckDB SQL for the registered queries that SQL can express, on views of the test tables."""

from __future__ import annotations

WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Windows of the items against windows of the documents, by hash join; hit words are the union of the covered positions.
DECONTAMINATE = f"""
with item as (select cast(item_id as varchar) item_id, {WORDS.format("coalesce(text, '')")} w from benchmark),
pattern as (
  select distinct item_id, least(10, len(w)) n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') p
  from (select item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) i from item where len(w) > 0)),
doc as (select doc_id, {WORDS.format("coalesce(text, '')")} w from documents),
win as (
  select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') p
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i from doc, (select distinct n from pattern) where len(w) >= n)),
hit as (select doc_id, i, win.n, item_id from win join pattern on win.p = pattern.p and win.n = pattern.n),
covered as (select doc_id, count(distinct word) n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) word from (select distinct doc_id, i, n from hit)) group by 1),
named as (select doc_id, count(distinct item_id) n_items, array_to_string(list_sort(list(distinct item_id)), ',') items from hit group by 1)
select doc.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, n_hit is not null contaminated
from doc left join covered on doc.doc_id = covered.doc_id left join named on doc.doc_id = named.doc_id
"""

_HOST = "nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '')"
URL_FILTER = f"""
with capture as (
  select page_id, {_HOST} host, timestamp '2023-01-01' + to_minutes(cast((page_id * 7919) % 1051200 as integer)) fetched from pages),
listed as (
  select distinct case when host like 'm.%' then host else array_to_string(string_split(host, '.')[greatest(len(string_split(host, '.')) - 2, 1):], '.') end pattern
  from capture where host is not null),
picked as (select pattern, h, ['spam', 'malware', 'adult'][cast(h % 3 as integer) + 1] category from (select pattern, cast(('0x' || substr(md5(pattern), 1, 8)) as bigint) h from listed) where h % 5 = 0),
entry as (
  select pattern, category, 'add' act, timestamp '2023-01-01' + to_days(cast(h % 400 as integer)) t from picked
  union all select pattern, category, 'remove', timestamp '2023-01-01' + to_days(cast(h % 400 + 200 as integer)) from picked
  union all select pattern, category, 'add', timestamp '2023-01-01' + to_days(cast(h % 400 + 300 as integer)) from picked where h % 15 = 0),
span as (select * from (select pattern, category, act, t since, lead(t) over (partition by pattern, category order by t) until from entry) where act = 'add'),
host_part as (select host, array_to_string(string_split(host, '.')[i:], '.') pattern from (select host, unnest(generate_series(1, len(string_split(host, '.')))) i from (select distinct host from capture where host is not null))),
hit as (
  select page_id, s.category, s.pattern from capture c join host_part p on c.host = p.host join span s on s.pattern = p.pattern
  where s.since <= c.fetched and (s.until is null or c.fetched < s.until)),
page_hit as (select page_id, array_to_string(list_sort(list(distinct category)), ',') categories, arg_max(pattern, length(pattern)) pattern from hit group by 1)
select c.page_id, host, strftime(fetched, '%Y-%m-%d %H:%M') fetched, coalesce(categories, '') categories, pattern, h.page_id is not null blocked
from capture c left join page_hit h on c.page_id = h.page_id
"""

#: All pairs of a label, by cosine; components by spreading the least identifier.
EMBEDDINGS = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings),
fine as (select * from v where label is not null and vec_id is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
pair as (select a.vec_id a, b.vec_id b from fine a join fine b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select vec_id a, vec_id b from v union select reach.a, pair.b from reach join pair on reach.b = pair.a),
root as (select a, min(b) component_id from reach group by a),
deg as (select a, count(*) n from pair group by a)
select v.vec_id, coalesce(n, 0) n_links, component_id, v.vec_id = component_id kept from v join root on v.vec_id = root.a left join deg on v.vec_id = deg.a
"""

#: Shingle sets joined on their shingles; components by spreading the least identifier.
JACCARD = """
with recursive doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
shingle as (
  select distinct doc_id, array_to_string(w[i : i + 3], ' ') s from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) i from doc where len(w) > 0)),
size as (select doc_id, count(*) n from shingle group by 1),
shared as (select a.doc_id a, b.doc_id b, count(*) c from shingle a join shingle b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
pair as (select a, b from shared join size x on x.doc_id = a join size y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
reach as (select doc_id a, doc_id b from doc union select reach.a, pair.b from reach join pair on reach.b = pair.a),
root as (select a, min(b) component_id from reach group by a)
select doc.doc_id, coalesce(n, 0) n_shingles, component_id from doc join root on doc.doc_id = root.a left join size on doc.doc_id = size.doc_id
"""


def mixing(rounds: int = 8, keep_share: float = 0.7, power: float = 0.7) -> str:
    """Raking and calibration over the cells, step by step."""
    dims = ("source", "lang", "topic")
    steps = [
        """with doc as (
  select doc_id, coalesce(source, '') source, coalesce(lang, '') lang, cast(ceil(strlen(coalesce(text, '')) / 4.0) as bigint) n_tokens,
    case when text like '% | %' then 'table' when lower(text) like '%license%' then 'legal' when text like '%!!%' then 'loud' when strlen(coalesce(text, '')) < 600 then 'note' else 'prose' end topic
  from documents)""",
        "w0 as (select source, lang, topic, cast(sum(n_tokens) as bigint) tokens, sum(n_tokens) / (select cast(sum(n_tokens) as double) from doc) w from doc group by 1, 2, 3 having sum(n_tokens) > 0)",
    ]
    for d in dims:
        steps.append(f"goal_{d} as (select {d}, pow(sum(w), {power}) / (select sum(g) from (select pow(sum(w), {power}) g from w0 group by {d})) g from w0 group by {d})")
    k = 0
    for _ in range(rounds):
        for d in dims:
            steps.append(f"w{k + 1} as materialized (select w{k}.* exclude (w), w * g / sum(w) over (partition by w{k}.{d}) w from w{k} join goal_{d} using ({d}))")
            k += 1
    steps += [
        f"rate as (select source, lang, topic, tokens, w / (select sum(w) from w{k}) w from w{k})",
        f"""scaled as (select *, ({keep_share} * sum(tokens) over () - coalesce(sum(tokens) over (o rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (o rows between current row and unbounded following) scale from rate window o as (order by w / tokens desc, source, lang, topic))""",
        "best as (select max(scale) scale from scaled where scale * w / tokens <= 1)",
        "chance as (select source, lang, topic, coalesce(least(1.0, (select scale from best) * w / tokens), 1.0) p from rate)",
    ]
    return (
        ",\n".join(steps)
        + """
select doc_id, source, lang, topic, n_tokens, round(case when n_tokens > 0 then coalesce(p, 0.0) else 0.0 end, 9) probability,
  cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '/mix'), 1, 8)) as bigint) / 4294967296.0 < (case when n_tokens > 0 then coalesce(p, 0.0) else 0.0 end) kept
from doc left join chance using (source, lang, topic)"""
    )


ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": DECONTAMINATE,
    "op5_embedding_dedup": EMBEDDINGS,
    "op7_jaccard_join": JACCARD,
    "op8_url_filter": URL_FILTER,
    "op10_mixing": mixing(),
}
