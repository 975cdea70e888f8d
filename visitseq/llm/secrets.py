"""Secrets in texts: three fixed patterns, and tokens that pass a battery of randomness tests.

Base kinds, leftmost and without overlap within a kind: ``assign`` (a key word, a sign and a
value), ``access`` (AKIA keys), ``hex``. The method adds the kind ``random``: runs of 20 or
more characters of a base64 alphabet, for which the narrowest usual encoding is inferred
(words and plain numbers are none). Under the hypothesis that the characters are drawn evenly
from that alphabet, three tests give p-values: chi-squared of the character counts, the runs
test on the upper and lower half of the alphabet, and circular serial correlation. Fisher's
method combines them into ``u``, even on (0, 1) for random tokens and small for others.

Short tokens give the tests little power, so false discoveries are controlled by encoding and
length class: the random tokens of a class are estimated by those with u > 1/2 (Storey), and
its threshold is the lowest u above which the rest makes up at most ``FDR`` of the tokens.
Counts per class and hundredth of u are all that is gathered over the corpus.

Everything is DataFrame functions. Null texts count as empty: no spans. Every row is treated by
itself, repeated rows and rows without doc_id included; other columns are not read unless
kept with ``keep``.
"""

from pyspark.sql import Column, DataFrame, functions as F

from visitseq.sources import materialize

# Fixed patterns of the base kinds, with the group whose length counts and its least length.
BASE = [
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
               r"([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
KINDS = ["assign", "access", "hex", "random"]
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
FDR = 0.1
_FAR = 2 ** 31 - 1
_BINS = 100
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_NO_WORDS = r"[0-9]|[a-z][A-Z]|[A-Z]{2}[a-z]"  # what words joined by signs do not hold
_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda computes what it captures each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(values: Column) -> Column:
    """The array in pieces of about the square root of its length."""
    def cut(v):
        size = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        last = F.floor((F.size(v) - 1) / size).cast("int")
        return F.when(F.size(v) > 0, F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda b: F.slice(v, b * size + 1, size))).otherwise(
                F.slice(F.array(v), 1, 0))
    return _let(values, cut)


def before_each(values: Column, combine, start: int = 0) -> Column:
    """For each element of an int array, all elements before it combined.

    Whole blocks first, then inside a block: steps grow with the power 1.5 of the length, and no
    array grows element by element.
    """
    def fold(array):
        return F.aggregate(array, F.lit(start), combine)

    def all_blocks(blocks):
        return _let(F.transform(blocks, fold), lambda totals: F.flatten(F.transform(
            blocks, lambda block, b: _let(fold(F.slice(totals, F.lit(1), b)), lambda first: F.transform(
                block, lambda _, i: F.aggregate(F.slice(block, F.lit(1), i), first, combine))))))
    return _let(_blocks(values), all_blocks)


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end, token>> of the matches whose group is long enough.

    The pieces between matches and the matches themselves add up to the positions.
    """
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("token"))

    def place(r):
        sizes = F.transform(r, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["all"]), F.lit(0)))
        return F.zip_with(r, before_each(sizes, lambda a, b: a + b), lambda x, at: F.struct(
            (at + F.length(x["gap"])).alias("start"),
            (at + F.length(x["gap"]) + F.length(x["all"])).alias("end"), x["token"].alias("token")))

    kind = "array<struct<start:int,end:int,token:string>>"
    found = F.filter(_let(rows, place), lambda x: F.length(x["token"]) >= least)
    return F.when(text.rlike(pattern), found.cast(kind)).otherwise(F.array().cast(kind))


def _ranked(found: Column, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))


def encoding_of(token: Column) -> Column:
    """Size and name of the narrowest usual alphabet; null for words and plain numbers."""
    out = F.when(~token.rlike(_NO_WORDS) | token.rlike(r"^[0-9/_+-]+$"), F.lit(None).cast("string"))
    for pattern, name in ((r"^([0-9a-f]+|[0-9A-F]+)$", "16"), (r"^[A-Z2-7]+$", "32"),
                          (r"^([a-z0-9]+|[A-Z0-9]+)$", "36"), (r"^[A-Za-z0-9]+$", "62")):
        out = out.when(token.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("64"))


def _places(token: Column, encoding: Column) -> Column:
    """The place of each character in its alphabet, from 1."""
    alphabets = [("16", "0123456789abcdef", F.lower(token)),
                 ("32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", token),
                 ("36", "0123456789abcdefghijklmnopqrstuvwxyz", F.lower(token)),
                 ("62", _BASE64[:62], token)]
    alphabet, text = F.lit(_BASE64), F.translate(token, "-_", "+/")
    for name, letters, own in alphabets:
        alphabet = F.when(encoding == name, letters).otherwise(alphabet)
        text = F.when(encoding == name, own).otherwise(text)
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.instr(alphabet, c).cast("double"))


def upper_tail(z: Column) -> Column:
    """P(N(0, 1) > z) by the rational approximation 26.2.17 of Abramowitz and Stegun."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937
                                     + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _facts(row: Column) -> Column:
    """Sums over the places of a token from which the three statistics follow."""
    x, half = row["x"], row["k"] / 2
    following = F.concat(F.slice(x, F.lit(2), F.size(x)), F.slice(x, 1, 1))
    return F.struct(
        *(row[c].alias(c) for c in ("start", "end", "encoding", "k")),
        F.size(x).cast("double").alias("n"),
        _sum(F.transform(F.array_distinct(x), lambda c: F.pow(
            F.size(F.filter(x, lambda y: y == c)), F.lit(2.0)))).alias("squares"),
        _sum(F.transform(x, lambda y: (y > half).cast("double"))).alias("high"),
        _sum(F.zip_with(x, following, lambda y, z: ((y > half) != (z > half)).cast("double")))
        .alias("turns"),
        ((F.element_at(x, 1) > half) != (F.element_at(x, -1) > half)).cast("double").alias("wrap"),
        _sum(x).alias("sum"), _sum(F.transform(x, lambda y: y * y)).alias("sum2"),
        _sum(F.zip_with(x, following, lambda y, z: y * z)).alias("lagged"))


def _randomness(row: Column) -> Column:
    """start, end, class, u."""
    n, k, least = row["n"], row["k"], F.lit(1e-12)
    chi = row["squares"] * k / n - n
    z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    both = 2 * row["high"] * (n - row["high"])
    runs = 1 + row["turns"] - row["wrap"]  # turns are counted around the end
    spread = both * (both - n) / (n * n * (n - 1))
    z_runs = F.when(spread > 0, (runs - both / n - 1) / F.sqrt(spread)).otherwise(F.lit(9.0))
    square = row["sum"] * row["sum"]
    width = n * row["sum2"] - square
    serial = (n * row["lagged"] - square) / width
    z_serial = F.when(width > 0, (serial + 1 / (n - 1)) * (n - 1)
                      / F.sqrt(n * (n - 3) / (n + 1))).otherwise(F.lit(9.0))
    logs = sum(-F.log(F.greatest(p, least)) for p in (
        upper_tail(z_chi), 2 * upper_tail(F.abs(z_runs)), 2 * upper_tail(F.abs(z_serial))))
    length = F.when(n < 24, "20").when(n < 32, "24").when(n < 48, "32").otherwise("48")
    return F.struct(row["start"].alias("start"), row["end"].alias("end"),
                    F.concat_ws("/", row["encoding"], length).alias("class"), logs.alias("logs"))


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, base spans, and every candidate token with its class and u."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.filter(F.transform(matches(text, TOKEN, 0, 20), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), m["token"].alias("token"),
        encoding_of(m["token"]).alias("encoding"))), lambda m: m["encoding"].isNotNull())
    placed = F.transform(tokens, lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), m["encoding"].alias("encoding"),
        m["encoding"].cast("double").alias("k"), _places(m["token"], m["encoding"]).alias("x")))
    tested = F.transform(F.transform(placed, _facts), _randomness)
    # Fisher: -2 * logs is chi-squared with six degrees of freedom, whose tail is closed
    tokens = F.transform(tested, lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), m["class"].alias("class"),
        (F.exp(-m["logs"]) * (1 + m["logs"] + m["logs"] * m["logs"] / 2)).alias("u")))
    base = F.array_sort(F.concat(*[_ranked(matches(text, pattern, group, least), rank)
                                   for rank, (_, pattern, group, least) in enumerate(BASE)]))
    return docs.select(*keep, base.cast(_SPANS).alias("_base"), tokens.alias("_tokens"))


def thresholds(scanned: DataFrame, fdr: float = FDR) -> dict[str, float]:
    """Least u of a secret in each class; a class has at most _BINS + 1 rows here."""
    bin_of = F.least(F.floor(F.col("t.u") * _BINS), F.lit(_BINS - 1)).cast("int")
    counts = (scanned.select(F.explode("_tokens").alias("t"))
              .groupBy(F.col("t.class").alias("class"), bin_of.alias("bin")).count().collect())
    out = {}
    for name in {row["class"] for row in counts}:
        own = [0] * _BINS
        for row in counts:
            if row["class"] == name:
                own[row["bin"]] = row["count"]
        random = 2 * sum(own[_BINS // 2:])
        for first in range(_BINS):
            found = sum(own[first:])
            if found - random * (1 - first / _BINS) <= fdr * found:
                out[name] = first / _BINS
                break
    return out


def find_secrets(docs: DataFrame, keep: list[str] | None = None, fdr: float = FDR) -> DataFrame:
    """The columns ``keep`` (doc_id) and spans: array<struct<start, rank, end>>, sorted.

    ``rank`` is the place in ``KINDS``. Positions are code points, the end exclusive. Tokens
    that overlap a base span add nothing.
    """
    keep = keep or ["doc_id"]
    scanned = materialize(scan(docs, keep), "secrets")
    limits = thresholds(scanned, fdr)

    def random(token):
        limit = F.lit(2.0)
        for name, value in sorted(limits.items()):
            limit = F.when(token["class"] == name, value).otherwise(limit)
        return token["u"] >= limit

    tokens = F.filter("_tokens", random)
    # base spans and tokens in one order: a token is free if no base span before it reaches into
    # it and none behind it begins inside
    marked = F.array_sort(F.concat(
        F.transform("_base", lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("token"),
                                                s["end"].alias("end"))),
        F.transform(tokens, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("token"),
                                               s["end"].alias("end")))))

    def free(rows):
        reach = before_each(F.transform(rows, lambda s: F.when(
            s["token"] == 0, s["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        begin = F.reverse(before_each(F.reverse(F.transform(rows, lambda s: F.when(
            s["token"] == 0, s["start"]).otherwise(_FAR))), lambda a, b: F.least(a, b), _FAR))
        return F.filter(F.zip_with(F.zip_with(rows, reach, lambda s, r: F.struct(
            s.alias("s"), r.alias("reach"))), begin, lambda x, n: F.when(
                (x["s"]["token"] == 1) & (x["reach"] <= x["s"]["start"])
                & (n >= x["s"]["end"]), x["s"])), lambda s: s.isNotNull())

    new = F.when(F.size(tokens) > 0, _let(marked, free)).otherwise(
        F.array().cast("array<struct<start:int,token:int,end:int>>"))
    added = _ranked(new, KINDS.index("random"))
    return scanned.select(*keep, F.array_sort(F.concat("_base", added)).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; spans that overlap are one.

    Spans are taken in blocks, and the texts between them from the part of their block: a place
    deep in a long text costs the way to it.
    """
    def rows(s):
        reach = before_each(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        return F.zip_with(s, reach, lambda x, at: F.struct(
            at.alias("at"), x["start"].alias("start"), F.greatest(at, x["end"]).alias("next"),
            ((x["start"] >= at) & (x["end"] > 0)).alias("apart")))

    def block(b):
        first = F.get(b, F.lit(0))["at"]
        own = F.substring(text, first + 1, F.element_at(b, -1)["next"] - first)
        return _let(own, lambda part: F.array_join(F.transform(b, lambda x: F.when(
            x["apart"], F.concat(F.substring(part, x["at"] - first + 1, x["start"] - x["at"]),
                                 F.lit(mark))).otherwise("")), ""))

    def whole(s):
        end = F.array_max(F.transform(s, lambda x: x["end"]))
        return F.concat(F.array_join(F.transform(_blocks(rows(s)), block), ""),
                        F.substring(text, end + 1, F.length(text)))
    return F.when(F.size(spans) > 0, _let(spans, whole)).otherwise(text)
