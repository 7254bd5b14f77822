"""Secret scans with DataFrame functions only.

Base detections are regular expressions; their places come from cutting the text at the matches and
adding up lengths.  The method adds candidate strings (long runs of one encoding alphabet) whose Shannon
entropy over a sliding window of WINDOW characters reaches the threshold of their character class.  The
window slides by incremental counts: one character enters, one leaves, and the sum of c * log2(c) moves by
table differences, so a candidate costs time in proportion to its length.  Candidates that the allow-list
covers are suppressed, and so are those inside a base detection; a placeholder word suppresses the windows it
lies in, not the rest of a path.

Everything is per row: no shuffle, no Python on the executors, and the costlier steps run only for texts
that a first look says can hold a match.  A candidate is taken apart into single characters STRETCH at a time (each
stretch with the WINDOW - 1 characters that follow it, so that no window is missed), and the matches of a text are laid
out BLOCK at a time, so neither a very long candidate nor a text of very many matches costs more than its length in memory.

Defined results: a null text is empty; empty texts have no spans; repeated rows each get their own result;
offsets count code points, ends exclusive; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and the least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # a run is maximal, so its least length can stand in the pattern
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "entropy")

#: Characters in the sliding window.
WINDOW = 20
#: Least entropy (bits a character) by character class.
THRESHOLDS = {"hex": 3.0, "base64": 3.8}
ALPHABETS = {"hex": "0123456789abcdef", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"}
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{WINDOW},}}"
#: No secrets: candidates that are universally unique identifiers or numbers, and windows that meet a placeholder word.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_-]+$",
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?(?:key|token|secret)|xxxxx|abcdefgh|012345678|lorem",
)
#: The stretches of a candidate between its placeholder words; only group 1 is one.
BETWEEN = rf"{ALLOWED[2]}|((?:(?!{ALLOWED[2]})[A-Za-z0-9+/_-])+)"
#: A candidate must mix its characters: letters with digits, or capitals inside a word more than once.
MIXED = (r"[A-Za-z][+/_-]?[0-9]", r"[0-9][+/_-]?[A-Za-z]", r"[a-z][A-Z]+[a-z]+[A-Z]")

#: Characters of a candidate that are taken apart at a time, and matches of a text whose places are added up at a time.
STRETCH, BLOCK = 4096, 256

SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
def _none() -> Column:
    return F.array().cast(SPANS)



def _places(text: Column, guard: Column, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more, as SPANS; nothing where ``guard`` fails."""
    cut = F.arrays_zip(
        F.split(text, pattern, -1).alias("before"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("held"),
    )

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["held"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda x: F.struct((x["start"] + by).alias("start"), x["kind"].alias("kind"), (x["end"] + by).alias("end"), x["value"].alias("value")))

    zero = F.struct(F.lit(0).cast("long").alias("at"), _none().alias("out"))
    none = F.array().cast(f"array<{SPANS}>")

    def laid_out(all_: Column) -> Column:
        """Places within each block of matches, then those of the blocks: appending costs BLOCK per match, not their number."""
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(all_, b * BLOCK + 1, BLOCK), zero, add))
        whole = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
        return F.aggregate(blocks, whole, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved(x["out"], acc["at"]))).alias("out")), lambda acc: F.flatten(acc["out"]))

    return F.when(guard, F.element_at(F.transform(F.array(cut), laid_out), 1)).otherwise(_none())


def _hot(value: Column, kind: str) -> Column:
    """``_hot_in`` of a candidate, by stretches."""
    # each stretch, with what follows it up to the end of its last window
    cut = F.regexp_extract_all(value, F.lit(f"(?=(.{{1,{STRETCH + WINDOW - 1}}})).{{1,{STRETCH}}}"), F.lit(1))
    each = F.transform(cut, lambda part: _hot_in(part, kind))
    at = lambda k: k * STRETCH
    places = F.transform(each, lambda h, k: F.struct(F.when(h["first"] >= 0, h["first"] + at(k)).alias("first"), F.when(h["first"] >= 0, h["last"] + at(k)).alias("last")))
    return F.element_at(
        F.transform(
            F.array(places),
            lambda ps: F.struct(
                F.coalesce(F.array_min(F.transform(ps, lambda p: p["first"])), F.lit(-1)).alias("first"),
                F.coalesce(F.array_max(F.transform(ps, lambda p: p["last"])), F.lit(-1)).alias("last"),
            ),
        ),
        1,
    )


def _hot_in(value: Column, kind: str) -> Column:
    """Struct (first, last): start of the first and end of the last window of ``value`` whose entropy reaches the threshold."""
    size, table = len(ALPHABETS[kind]), F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    # H = log2(WINDOW) - sum(c * log2(c)) / WINDOW
    most = WINDOW * (math.log2(WINDOW) - THRESHOLDS[kind]) + 1e-9
    chars = F.filter(F.split(F.lower(value) if kind == "hex" else value, ""), lambda ch: ch != "")
    codes = F.transform(chars, lambda ch: F.instr(F.lit(ALPHABETS[kind]), ch))

    def slide(cs: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            # One place past the end nothing enters: the last window is only looked at.
            enters, leaves = F.coalesce(F.get(cs, i), F.lit(0)), F.when(i >= WINDOW, F.get(cs, i - WINDOW)).otherwise(0)
            has, had = F.get(acc["counts"], enters - 1), F.get(acc["counts"], leaves - 1)
            moved = F.when(enters == leaves, 0.0).otherwise(
                F.coalesce(F.get(table, has + 1) - F.get(table, has), F.lit(0.0)) + F.coalesce(F.get(table, had - 1) - F.get(table, had), F.lit(0.0))
            )
            hot = (i >= WINDOW) & (acc["sum"] <= most)
            return F.struct(
                F.transform(acc["counts"], lambda c, k: c + F.when(k == enters - 1, 1).otherwise(0) - F.when(k == leaves - 1, 1).otherwise(0)).alias("counts"),
                (acc["sum"] + moved).alias("sum"),
                F.when(hot & (acc["first"] < 0), i - WINDOW).otherwise(acc["first"]).alias("first"),
                F.when(hot, i).otherwise(acc["last"]).alias("last"),
            )

        zero = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.size(cs)), zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return F.element_at(F.transform(F.array(codes), slide), 1)


def _entropy_span(c: Column) -> Column:
    """A candidate narrowed to its hot windows; ``end`` is 0 if it has none."""
    hot = F.when(c["value"].rlike("^[0-9a-fA-F]+$"), _hot(c["value"], "hex")).otherwise(_hot(c["value"], "base64"))
    return F.element_at(
        F.transform(
            F.array(hot),
            lambda h: F.struct(
                (c["start"] + h["first"]).alias("start"),
                F.lit(KINDS.index("entropy")).alias("kind"),
                F.when(h["first"] < 0, F.lit(0).cast("long")).otherwise(c["start"] + h["last"]).alias("end"),
                F.substring(c["value"], h["first"] + 1, h["last"] - h["first"]).alias("value"),
            ),
        ),
        1,
    )


def _between(c: Column) -> Column:
    """A candidate as SPANS: whole if it holds no placeholder word, else its stretches of WINDOW characters or more between them."""
    worded = c["value"].rlike(ALLOWED[2])
    cut = F.transform(
        _places(c["value"], worded, BETWEEN, 3, WINDOW, 1),
        lambda s: F.struct((c["start"] + s["start"]).alias("start"), s["kind"].alias("kind"), (c["start"] + s["end"]).alias("end"), s["value"].alias("value")),
    )
    return F.when(worded, cut).otherwise(F.array(c))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, base and found (all spans), each an array of (start, kind index, end, value) by start, then kind."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    assign = _places(text, text.rlike(ASSIGN), ASSIGN, 0, ASSIGN_LEAST, 1)
    access = _places(text, text.contains("AKIA"), ACCESS, 1, ACCESS_LEAST)
    runs = _places(text, text.rlike(HEX), HEX, 2, 0)
    rows = rows.select("doc_id", F.array_sort(F.concat(assign, access, runs)).alias("base"), _places(text, text.rlike(CANDIDATE), CANDIDATE, 3, WINDOW).alias("candidates"))
    allowed = lambda v: v.rlike(ALLOWED[0]) | v.rlike(ALLOWED[1])
    mixed = lambda v: v.rlike(MIXED[0]) | v.rlike(MIXED[1]) | v.rlike(MIXED[2])
    likely = F.filter("candidates", lambda c: mixed(c["value"]) & ~allowed(c["value"]))
    likely = F.filter(F.flatten(F.transform(likely, _between)), lambda c: mixed(c["value"]) & ~allowed(c["value"]))
    hot = F.filter(F.transform(likely, _entropy_span), lambda s: s["end"] > 0)
    rows = rows.select("doc_id", "base", hot.alias("hot"))
    fresh = F.filter("hot", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", fresh)).alias("found"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
