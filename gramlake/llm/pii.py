"""Personal data in texts: base patterns, and identifiers found by bootstrapped contexts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlake.llm.common import cut, read

#: The base kinds in the order in which equal starts sort; what contexts discover comes after them.
KINDS = ("email", "ip", "card", "phone")
FOUND = "secret"
# Patterns are possessive and start where a run starts or the last match ended (\G), so that they find what
# the plain greedy ones find, in linear time and without deep recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
#: A number written with blanks: at most eight white-space tokens of digits and number marks, the first of which may begin with four letters.
_NUMBER = r"[^\s\p{L}\p{N}]*+\p{L}{0,4}+[0-9][0-9()./+-]*+(?!\S*[\p{L}\p{N}])(?:\x20[0-9(][0-9()./-]*+(?!\S*[\p{L}\p{N}])){0,7}+\S*+"
#: What may be an identifier: such a number, or else a white-space token with a digit or with an @ inside.
_TOKEN = rf"(?<!\S)(?:{_NUMBER}|[^\s0-9@]++@\S++|[^\s0-9]*+[0-9]\S*+)"
#: Least length of an identifier's core, the digits it has at least, and what is a seed by shape alone.
CORE_CHARS, CORE_DIGITS, SEED_SHAPE = 6, 3, r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,128}$"
#: Different well-scored identifiers that a pattern needs, and the scores that patterns and identifiers need.
SUPPORT, PATTERN_SCORE, INSTANCE_SCORE = 3, 0.6, 0.6
#: Scoring ends when no pattern's score changes by more than SETTLED, or after MOST_ROUNDS rounds.
SETTLED, MOST_ROUNDS = 0.001, 12
#: Code points before and after a token that hold its context's words as a rule; longer words are looked up in all of the text between.
NEAR = 60
#: Identifiers of more code points are told apart by their SHA-256 while patterns are scored.
LONG = 128

_SPANS = "array<struct<s:int,e:int,m:string>>"
_FOUND = "array<struct<s:int,r:int,e:int,kind:string,m:string>>"


def _placed(pieces: Column, row, kind: str) -> Column:
    """``row(start, piece)`` of every piece that has one, for pieces of text in order, each with n code points before a match m.

    Prefix sums by blocks of about the square root of the number of pieces: no array grows by one element a match.
    """
    none = F.array().cast(kind)
    wide = lambda x: x["n"] + F.coalesce(F.length(x["m"]), F.lit(0))

    def step(acc, x):
        start = acc["p"] + x["n"]
        new = row(start, x)
        return F.struct((acc["p"] + wide(x)).alias("p"), F.when(new.isNull(), acc["a"]).otherwise(F.concat(acc["a"], F.array(new))).alias("a"))

    def within(blocks):
        widths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda t, x: t + wide(x)))
        starts = F.aggregate(widths, F.array(F.lit(0)), lambda t, w: F.concat(t, F.array(F.element_at(t, -1) + w)))
        each = F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda b, at: F.aggregate(b, F.struct(at.alias("p"), none.alias("a")), step, lambda acc: acc["a"]))
        return F.flatten(each)

    def cut_up(p):
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(p))).cast("int"))
        return _let(F.transform(F.sequence(F.lit(0), F.ceil(F.size(p) / size).cast("int") - 1), lambda k: F.slice(p, k * size + 1, size)), within)

    return _let(pieces, cut_up)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, pattern: str) -> Column:
    """Start, end and string of every match in code points: lengths of the parts between matches add up."""
    pieces = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("n"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"))
    return _placed(pieces, lambda start, x: F.when(x["m"].isNotNull(), F.struct(start.alias("s"), (start + F.length(x["m"])).alias("e"), x["m"].alias("m"))), _SPANS)


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(_IP)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def base_spans(text: Column) -> Column:
    """The base spans of a text, each as (start, rank of its kind, end, kind, string), in that order."""
    marks = {"email": "@", "phone": "+"}

    def of(rank: int, kind: str) -> Column:
        likely = F.instr(text, marks[kind]) > 0 if kind in marks else text.rlike("[0-9]")
        valid = F.filter(_matches(text, PATTERNS[kind]), lambda x: _valid(kind, x["m"]))
        spans = F.transform(valid, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("r"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m")))
        return F.when(likely, spans).otherwise(F.array().cast(_FOUND))

    return F.array_sort(F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS)]))


def _candidates(text: Column) -> Column:
    """What may be an identifier: start and end of its core, the core, and the lexical patterns around it.

    The core has neither the marks that open a token (but for a plus sign) nor those that close it, as base spans have.
    One pattern is the two words before the token, in lower case, and the marks that open it; another the marks that
    close it and the two words after it. Whatever lies between such tokens is a piece; a context doesn't reach past one.
    """
    before = lambda x: F.lower(F.when(F.length(x) <= NEAR, F.regexp_extract(x, r"((?:\S+\s+)?\S+)\s*$", 1)).otherwise(F.coalesce(F.nullif(F.regexp_extract(F.substring(x, -NEAR, NEAR), r"\s(\S+\s+\S+)\s*$", 1), F.lit("")), F.regexp_extract(x, r"(?<!\S)((?:\S++\s++)?\S++)\s*+$", 1))))
    after = lambda x: F.lower(F.regexp_extract(x, r"^\s*+(\S++(?:\s++\S++)?)", 1))
    gaps = F.transform(F.split(text, _TOKEN, -1), lambda x: F.struct(F.length(x).alias("n"), before(x).alias("before"), after(x).alias("after")))
    found = F.regexp_extract_all(text, F.lit(_TOKEN), 0)
    following = lambda g: F.slice(F.concat(F.transform(g, lambda x: x["after"]), F.array(F.lit(""))), F.lit(2), F.size(g))
    named = lambda g: F.transform(F.arrays_zip(g.alias("g"), found.alias("m"), following(g).alias("f")), lambda x: F.struct(x["g"]["n"].alias("n"), x["m"].alias("m"), x["g"]["before"].alias("before"), x["f"].alias("after")))
    pieces = _let(gaps, named)
    kind = "array<struct<s:int,m:string,before:string,after:string>>"
    tokens = _placed(pieces, lambda start, x: F.when(F.length(x["m"]) >= CORE_CHARS, F.struct(start.alias("s"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))), kind)

    def core(x):
        opening = F.regexp_extract(x["m"], r"^[^\p{L}\p{N}]*?(?=\+?[\p{L}\p{N}])", 0)
        rest = F.substring(x["m"], F.length(opening) + 1, F.length(x["m"]))
        inner = F.regexp_replace(rest, r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
        closing = F.substring(rest, F.length(inner) + 1, F.length(rest))
        start = x["s"] + F.length(opening)
        left, right = F.concat_ws(" ", x["before"], opening), F.concat_ws(" ", closing, x["after"])
        return F.struct(start.alias("s"), (start + F.length(inner)).alias("e"), inner.alias("v"), F.filter(F.array(F.when(F.trim(left) != "", F.concat(F.lit("<"), left)), F.when(F.trim(right) != "", F.concat(F.lit(">"), right))), lambda p: p.isNotNull()).alias("ps"))

    shaped = F.filter(F.transform(tokens, core), lambda x: F.length(x["v"]) >= CORE_CHARS)
    return F.when(text.rlike("[0-9@]"), shaped).otherwise(F.array().cast("array<struct<s:int,e:int,v:string,ps:array<string>>>"))


def _covered(candidates: Column, base: Column) -> Column:
    """The candidates with whether a base span overlaps each: blocks of base spans are skipped by their least start and greatest end."""

    def block(q):
        return F.struct(q.alias("q"), F.array_min(F.transform(q, lambda b: b["s"])).alias("lo"), F.array_max(F.transform(q, lambda b: b["e"])).alias("hi"))

    def mark(blocks):
        hit = lambda x: F.exists(blocks, lambda g: (g["lo"] < x["e"]) & (g["hi"] > x["s"]) & F.exists(g["q"], lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))
        return F.transform(candidates, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), x["ps"].alias("ps"), hit(x).alias("covered")))

    size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(base))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(base) / size).cast("int") - 1), lambda k: _let(F.slice(base, k * size + 1, size), block))
    return F.when(F.size(base) > 0, _let(blocks, mark)).otherwise(F.transform(candidates, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), x["ps"].alias("ps"), F.lit(False).alias("covered"))))


def _score(instances: DataFrame) -> DataFrame:
    """Iterative scores on the pattern-instance graph (p, v, seed): p, v, ps (pattern) and vs (instance) for each edge.

    An instance's score is that of at least one of its patterns being right; seeds keep 1. A pattern's score is the mean
    of its instances' scores, each without this pattern's own part, so that no pattern raises itself; it is 0
    unless SUPPORT of its instances score INSTANCE_SCORE or more. Scores only rise, and rounds end when they have settled.
    """
    edges = cut(instances.groupBy("p", "v").agg(F.max("seed").alias("seed")))
    state = edges.withColumn("others", F.col("seed").cast("double"))  # the instance's score but for this pattern
    old = None
    for _ in range(MOST_ROUNDS):
        well = F.count(F.when(F.col("others") >= INSTANCE_SCORE, 1))
        pattern = cut(state.groupBy("p").agg(F.when(well >= SUPPORT, F.avg("others")).otherwise(0.0).alias("ps")))
        scored = edges.join(pattern, "p").withColumn("miss", F.log1p(-0.999 * F.col("ps")))
        total = scored.groupBy("v").agg(F.sum("miss").alias("all"))
        state = scored.join(total, "v").withColumn("others", F.greatest(F.col("seed").cast("double"), 1 - F.exp(F.col("all") - F.col("miss"))))
        if old is not None and not (pattern.join(old.withColumnRenamed("ps", "was"), "p").agg(F.max(F.abs(F.col("ps") - F.col("was")))).first()[0] or 0.0) > SETTLED:
            break
        old = pattern
    return state.select("p", "v", "ps", F.greatest(F.col("seed").cast("double"), 1 - F.exp("all")).alias("vs"))


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, base (array of base spans), added (array of discovered spans) for every row.

    Base spans are found where they stand, without a shuffle. Seeds are tokens, or numbers written with blanks, that
    hold a base span or have a key's shape (SEED_SHAPE); the words and marks before and after them are patterns; patterns
    and tokens score each other over the whole table; tokens of a high-scored pattern that no base span covers are
    added as ``secret``. Shuffles: edges of such tokens, pre-aggregated, and one small row a
    document. Null and empty texts have no spans; equal rows get equal results; rows that share a key but
    not a text are told apart by the text's hash; other columns are not read; an empty table gives no rows.
    """
    text_or_none = F.coalesce(docs[text], F.lit(""))
    own = docs.select(docs[key].alias("k"), F.xxhash64(text_or_none).alias("h"), F.length(text_or_none).alias("z"), base_spans(text_or_none).alias("base"), _candidates(text_or_none).alias("c"))
    own = cut(own)
    digits = F.length(F.regexp_replace("v", "[^0-9]", ""))
    apart = own.where(F.size("c") > 0).select("k", "h", "z", F.explode(_covered(F.col("c"), F.col("base"))).alias("c")).select("k", "h", "z", "c.*").where(F.col("covered") | (digits >= CORE_DIGITS))
    apart = apart.select("k", "h", "z", "s", "e", "v", "covered", F.when(F.length("v") > LONG, F.sha2("v", 256)).otherwise(F.col("v")).alias("name"), F.explode("ps").alias("p"))
    graph = _score(apart.select("p", F.col("name").alias("v"), (F.col("covered") | F.col("v").rlike(SEED_SHAPE)).cast("int").alias("seed")))
    high = graph.where((F.col("ps") >= PATTERN_SCORE) & (F.col("vs") >= INSTANCE_SCORE)).select("p", F.col("v").alias("name"))
    discovered = apart.where("not covered").join(high, ["p", "name"]).groupBy("k", "h", "z").agg(F.collect_set(F.struct("s", F.lit(len(KINDS)).alias("r"), "e", F.lit(FOUND).alias("kind"), F.col("v").alias("m"))).alias("added"))
    named = discovered.select(F.col("k").alias("k2"), F.col("h").alias("h2"), F.col("z").alias("z2"), "added")
    out = own.join(named, F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2")) & (F.col("z") == F.col("z2")), "left")
    return out.select(F.col("k").alias(key), "base", F.coalesce("added", F.array().cast(_FOUND)).alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(kind) for kind in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_secret"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


QUERIES = {"op4_pii": op4_pii}
