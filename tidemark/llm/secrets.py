"""Secret scans with multipart credential linking, in DataFrame functions only (operator 7).

Base spans, leftmost and non-overlapping a kind: `assign` (a secret's name, then its value of 6 or
more characters), `access` (AKIA..., 20 or more characters), `hex` (24 or more hex digits).
Positions are code points, ends exclusive; they follow from the lengths of the matches and of the
gaps that a split by the same pattern leaves.

Linking works on weak parts, which say little alone: `login` (a user's or client's name assigned),
`opaque` (a run of 20 or more characters of mixed case with digits) and `endpoint` (scheme and
host).  The parts of a text are joined on the distance between their intervals: a weak secret
(`opaque`) is reported when an identifier (`access`, `login`) or an endpoint lies within `SCOPE`
code points of it; a `login` when a secret (`assign`, `hex`, `opaque`) does.  Parts that overlap a
base span aren't reported again.  All of a text's parts stay in its row, so nothing is shuffled.
Positions and neighbours are found by blocks of `BLOCK` parts, so that a text full of them stays cheap.

Defined results: a null or empty text has no spans; base_sha256 is then the hash of an empty string.
Each input row gives one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = 200
BLOCK = 256
_PLACE = "array<struct<start:int,end:int>>"
#: The patterns of the base kinds, with the least length of what they match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run that is too short holds no longer one, so the length may stand in the pattern
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")
LOGIN = r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9A-Z+/_-]*[a-z])(?=[0-9a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+"
#: A text that can match at all; tried first, since most texts hold none of the parts.
_GATE = {"assign": ASSIGN, "access": "AKIA", "hex": HEX, "login": LOGIN, "opaque": "[A-Za-z0-9+/_-]{20}", "endpoint": "://"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once; inside a lambda of `body` a plain column would be evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    """The array in pieces of at most BLOCK elements; one empty piece if it has none."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: F.slice(items, at + 1, BLOCK))


def _places(sizes: Column) -> Column:
    """ARRAY<STRUCT<start, end>> out of ARRAY<STRUCT<gap, size>>: running sums inside blocks, then over the blocks."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_PLACE).alias("out"))
    one = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["size"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("end")))).alias("out"),
    )
    sums = F.transform(_let(sizes, _blocks), lambda block: F.aggregate(block, start, one))
    moved = lambda block, by: F.transform(block["out"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end")))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_PLACE}>").alias("out"))
    add = lambda acc, block: F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(moved(block, acc["at"]))).alias("out"))
    return F.flatten(F.aggregate(sums, first, add, lambda acc: acc["out"]))


def _spans(text: Column, kind: str, pattern: str, value: int = 0, least: int = 0) -> Column:
    """ARRAY<STRUCT<kind, start, end>> of the pattern's matches whose group `value` has `least` characters."""
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length)
    sizes = _let(gaps, lambda g: F.transform(whole, lambda size, i: F.struct(F.element_at(g, i + 1).alias("gap"), size.alias("size"))))
    found = F.transform(_places(sizes), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    if least:
        long = F.transform(F.regexp_extract_all(text, p, F.lit(value)), lambda v: F.length(v) >= least)
        both = F.arrays_zip(found.alias("s"), long.alias("ok"))
        found = F.transform(F.filter(both, lambda x: x["ok"]), lambda x: x["s"])
    return F.when(text.rlike(_GATE[kind]), found).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int>>"))


def _ranges(*kinds: Column) -> Column:
    """The intervals of several kinds in blocks with their bounds; an empty block has bounds that nothing meets."""
    bound = lambda block: F.struct(
        F.coalesce(F.array_min(F.transform(block, lambda s: s["start"])), F.lit(2_000_000_000)).alias("start"),
        F.coalesce(F.array_max(F.transform(block, lambda s: s["end"])), F.lit(-1_000_000_000)).alias("end"),
        block.alias("items"),
    )
    return F.concat(*(F.transform(_let(k, _blocks), bound) for k in kinds))


def _near(parts: Column, ranges: Column, scope: int, keep: bool = True) -> Column:
    """Those parts that lie within `scope` of an interval of `ranges`, or those that don't."""
    meets = lambda a, b: (a["start"] < b["end"] + scope) & (b["start"] < a["end"] + scope)
    hit = lambda p, r: F.exists(r, lambda block: meets(block, p) & F.exists(block["items"], lambda o: meets(o, p)))
    return _let(ranges, lambda r: F.filter(parts, lambda p: hit(p, r) if keep else ~hit(p, r)))


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets", scope: int = SCOPE) -> DataFrame:
    """docs with the column `out` STRUCT<base, linked>: arrays of STRUCT<kind, start, end>, by start, then kind as listed."""
    text, mark = F.coalesce(F.col(text_col), F.lit("")), "__secrets"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    found = {
        "assign": _spans(text, "assign", ASSIGN, 1, 6),
        "access": _spans(text, "access", ACCESS),
        "hex": _spans(text, "hex", HEX),
        "login": _spans(text, "login", LOGIN),
        "opaque": _spans(text, "opaque", OPAQUE),
        "endpoint": _spans(text, "endpoint", ENDPOINT),
    }
    r = lambda k: F.col(f"{mark}{k}")
    base = F.concat(*(r(k) for k in KINDS))
    covered = _ranges(*(r(k) for k in KINDS))
    opaque = _near(_near(r("opaque"), covered, 0, keep=False), _ranges(r("access"), r("login"), r("endpoint")), scope)
    login = _near(_near(r("login"), covered, 0, keep=False), _ranges(r("assign"), r("hex"), r("opaque")), scope)
    weak = (F.size(r("opaque")) > 0) | (F.size(r("login")) > 0)
    linked = F.when(weak, F.concat(login, opaque)).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    # the parts are columns of their own, so that each pattern runs once a text
    parts = docs.withColumns({f"{mark}{k}": v for k, v in found.items()})
    return parts.withColumn(out, F.struct(_sorted(base).alias("base"), _sorted(linked).alias("linked"))).drop(*(f"{mark}{k}" for k in found))


def _sorted(spans: Column) -> Column:
    order = F.array(*map(F.lit, (*KINDS, "login", "opaque")))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _pieces(text: Column, spans: Column, mark: str) -> Column:
    """What is left of the text before each of the sorted spans, each followed by `mark`, then what is left after the last.

    A span that begins inside an earlier one goes with it.  The text is cut at every BLOCK spans first, and then
    within the blocks, so that no span takes a walk over the whole text.
    """
    place = "array<struct<done:int,start:int,end:int>>"
    # `done`: code points of the text that earlier spans of the block deal with
    none = F.struct(F.lit(0).alias("at"), F.array().cast(place).alias("out"))
    one = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("done"), s["start"].alias("start"), s["end"].alias("end")))).alias("out")
    )
    blocks = F.transform(_let(spans, _blocks), lambda block: F.aggregate(block, none, one))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,end:int,out:{place}>>").alias("out"))
    add = lambda acc, block: F.struct(
        F.greatest(acc["at"], block["at"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), F.greatest(acc["at"], block["at"]).alias("end"), block["out"].alias("out")))).alias("out"),
    )

    def written(block: Column, part: Column) -> Column:
        """A block's pieces out of `part`, the text from the block's `at` to its `end`."""
        piece = lambda done, s: F.when(s["start"] < done, F.lit("")).otherwise(F.concat(F.substring(part, done - block["at"] + 1, s["start"] - done), F.lit(mark)))
        return F.array_join(F.transform(block["out"], lambda s: piece(F.greatest(s["done"], block["at"]), s)), "")

    cut = lambda block: F.transform(F.array(F.substring(text, block["at"] + 1, block["end"] - block["at"])), lambda part: written(block, part))[0]
    tail = lambda acc: F.concat(F.transform(acc["out"], cut), F.array(F.substring(text, acc["at"] + 1, F.length(text))))
    return F.aggregate(blocks, first, add, tail)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """docs with every span of `find_secrets` replaced by `mark` (overlapping spans by one); other columns stay as they are."""
    out = "__secrets"
    while out in docs.columns:
        out += "_"
    text, spans = F.col(text_col), _sorted(F.concat(F.col(f"{out}.base"), F.col(f"{out}.linked")))
    found = find_secrets(docs, text_col, out, scope)
    clean = F.array_join(_pieces(text, spans, mark), "")
    return found.withColumn(text_col, F.when((F.size(f"{out}.base") > 0) | (F.size(f"{out}.linked") > 0), clean).otherwise(text)).drop(out)


def report(docs: DataFrame) -> DataFrame:
    """Per row of documents: counts of the base kinds, base_sha256 and all spans as kind:start:end."""
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(_written(F.col("secrets.base")).cast("binary"), 256).alias("base_sha256"),
        _written(_sorted(F.concat("secrets.base", "secrets.linked"))).alias("spans"),
    )
