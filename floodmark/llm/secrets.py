"""Secrets in texts: fixed patterns, and character Markov models of random strings.

Only DataFrame functions are used. The patterns give base spans. Other long runs
of letters, digits and signs are scored by two first-order character models, one
of random strings and one of ordinary identifiers; a run whose log-likelihood
ratio exceeds a threshold is a span of kind ``markov``, unless it touches a base
span. Both models are trained from labelled samples: what the patterns find is
random, the words around it are ordinary.

Defined results: null counts as an empty text, without spans. Offsets count code
points, ends are exclusive. With no labelled strings both models are uniform, so
only the patterns find anything. Repeated rows give the same spans. Extra columns
pass through; outputs replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The kinds of base spans in order, their patterns, the group whose length counts, and that length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA)([A-Z0-9]{16,})"
HEX = r"()([0-9a-f]{24,})"
KINDS = ("assign", "access", "hex", "markov")
LEAST = 6
#: Runs that the models score.
RUN = r"()([A-Za-z0-9+/_=-]{16,})"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
#: Symbols of the models: 0 for any other character and for the start.
SYMBOLS = len(ALPHABET) + 1
#: Rows of the samples that random strings and ordinary identifiers are taken from, about.
RANDOM_ROWS, ORDINARY_ROWS = 20_000, 1_500
#: Pairs that the frequency of a single symbol counts for.
WEIGHT = 8.0
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string,first:bigint,last:bigint>>"
#: Log-likelihood ratio of a whole run, and for each character of it, at least.
TOTAL, MEAN = 12.0, 0.6


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x evaluated once for each row."""
    return F.transform(F.array(x), use)[0]


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op over each value and all before it, by doubling: about n log n steps for n values, none of which copies an array that grows."""
    powers = F.array(*[F.lit(1 << k) for k in range(31)])
    double = lambda s, p: F.transform(s, lambda x, i: F.when(i >= p, op(x, F.get(s, i - p))).otherwise(x))
    return _let(values, lambda v: F.aggregate(F.filter(powers, lambda p: p < F.size(v)), v, double))


def _matches(text: Column, pattern: str, kind: str, least: int = 0) -> Column:
    """start, rank, end, kind, value, first and last (start and end in bytes) of each match, by the lengths of what is between matches."""
    # the second group is the end of each pattern, and alone a match is matched as in its text
    value = lambda h: F.regexp_extract(h, pattern, 2)
    both = lambda f, g, h: (f(g) + f(h)).cast("long")
    add = lambda x, y: x + y

    def span(x: Column) -> Column:
        start, first = x["end"] - F.length(x["hit"]), x["last"] - F.octet_length(x["hit"])
        place = [start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")]
        return F.struct(*place, value(x["hit"]).alias("value"), first.alias("first"), x["last"].alias("last"))

    def spans(gaps: Column, hits: Column) -> Column:
        ends, lasts = (_running(F.zip_with(gaps, hits, lambda g, h: both(f, g, h)), add) for f in (F.length, F.octet_length))
        return F.transform(F.arrays_zip(hits.alias("hit"), ends.alias("end"), lasts.alias("last")), span)

    def found(gaps: Column) -> Column:
        before = F.slice(gaps, 1, F.size(gaps) - 1)
        out = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: spans(before, hits))
        return F.when(F.size(gaps) > 1, F.filter(out, lambda x: F.length(x["value"]) >= least)).otherwise(F.array().cast(_SPANS))

    return _let(F.split(text, pattern, -1), found)


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with base_spans, in the order of start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.concat(_matches(text, ASSIGN, "assign", LEAST), _matches(text, ACCESS, "access"), _matches(text, HEX, "hex"))
    return docs.withColumn("base_spans", F.array_sort(found))


@dataclass(frozen=True)
class MarkovPair:
    """Log-likelihood ratios of all pairs of symbols: random over ordinary."""

    ratio: tuple[float, ...]


def _pair_counts(words: DataFrame) -> DataFrame:
    """i (first symbol * SYMBOLS + second) and n of a column w of strings."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring(F.concat(F.lit(" "), F.col("w")), i, F.lit(2)))
    two = words.filter("length(w) > 0").select(F.explode(pairs).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    code = F.instr(F.lit(ALPHABET), F.substring("p", 1, 1)) * SYMBOLS + F.instr(F.lit(ALPHABET), F.substring("p", 2, 1))
    return two.groupBy(code.alias("i")).agg(F.sum("n").alias("n"))


def _part(docs: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About rows rows of docs, chosen by the hash of key."""
    return docs if total <= rows else docs.filter(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < int(1_000_003 * rows / total))


def fit_markov(docs: DataFrame, *, key: str = "doc_id", text_col: str = "text", random_rows: int = RANDOM_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> MarkovPair:
    """Trains both models on samples of about random_rows and ordinary_rows documents."""
    total = docs.count()
    docs = docs.select(key, F.coalesce(text_col, F.lit("")).alias("t"))
    random = base_spans(_part(docs, key, random_rows, total), "t").select(F.explode("base_spans.value").alias("w"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = _part(docs, key, ordinary_rows, total).select(F.explode(F.regexp_extract_all(plain, F.lit("[A-Za-z0-9_-]{4,}"), F.lit(0))).alias("w"))
    both = _pair_counts(random).withColumn("r", F.lit(True)).union(_pair_counts(words).withColumn("r", F.lit(False)))
    grid = docs.sparkSession.range(SYMBOLS * SYMBOLS).withColumnRenamed("id", "i")
    counts = grid.join(both, "i", "left").groupBy("i").agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(a) for a, c in (("x", F.col("r")), ("y", ~F.col("r")))])
    rows = counts.withColumns({"s": F.floor(F.col("i") / SYMBOLS), "t": F.col("i") % SYMBOLS, "all": F.lit(0)})
    total = lambda by, name: rows.groupBy(by).agg(F.sum("x").alias(f"x{name}"), F.sum("y").alias(f"y{name}"))
    share = rows.join(total("s", "s"), "s").join(total("t", "t"), "t")
    everything = Window.partitionBy("all")  # SYMBOLS * SYMBOLS rows
    share = share.withColumns({f"{c}0": F.sum(c).over(everything) for c in "xy"})
    # a pair's probability leans on that of its second symbol, so that symbols a model never saw stay unlikely in it
    alone = lambda c: (F.col(f"{c}t") + 0.5) / (F.col(f"{c}0") + 0.5 * SYMBOLS)
    smooth = lambda c: F.log((F.col(c) + WEIGHT * alone(c)) / (F.col(f"{c}s") + WEIGHT))
    out = share.select("i", (smooth("x") - smooth("y")).alias("d")).orderBy("i").collect()  # SYMBOLS * SYMBOLS rows
    return MarkovPair(tuple(r["d"] for r in out))


def find_secrets(docs: DataFrame, model: MarkovPair, *, text_col: str = "text", total: float = TOTAL, mean: float = MEAN) -> DataFrame:
    """docs with base_spans and spans: arrays of start, rank, end, kind, value and the same ends in bytes, in the order of start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ratio = F.array(*[F.lit(x) for x in model.ratio])

    def score(word: Column) -> Column:
        chars = F.split(word, "")
        zero = F.struct(F.lit(0).alias("c"), F.lit(0.0).alias("s"))
        nxt = lambda s, c: F.struct(F.instr(F.lit(ALPHABET), c).alias("c"), (s["s"] + F.element_at(F.col("__ratio"), s["c"] * SYMBOLS + F.instr(F.lit(ALPHABET), c) + 1)).alias("s"))
        return F.aggregate(F.filter(chars, lambda c: c != ""), zero, nxt)["s"]

    spanned = base_spans(docs, text_col).withColumn("__ratio", ratio)
    # in the order of the ends of runs and the starts of base spans, a run touches a base span where one before it ends behind its start
    events = F.array_sort(F.concat(
        F.transform(_matches(text, RUN, "markov"), lambda x: F.struct(x["end"].alias("at"), F.lit(0).alias("base"), F.lit(-1).cast("long").alias("end"), x.alias("x"))),
        F.transform("base_spans", lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("base"), b["end"].alias("end"), b.alias("x")))))
    spanned = spanned.withColumn("__events", events)
    reached = F.arrays_zip(F.col("__events"), _running(F.col("__events.end"), F.greatest).alias("reached"))
    free = F.filter(reached, lambda r: (r["__events"]["base"] == 0) & (r["reached"] <= r["__events"]["x"]["start"]))
    runs = F.transform(free, lambda r: r["__events"]["x"])
    likely = F.filter(runs, lambda x: (score(x["value"]) >= total) & (score(x["value"]) >= mean * F.length(x["value"])))
    return spanned.withColumn("spans", F.array_sort(F.concat("base_spans", likely))).drop("__ratio", "__events")


def joined(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_kind(kind: str) -> Column:
    return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")


def redact(docs: DataFrame, model: MarkovPair, *, text_col: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """docs with every span of the text replaced by mark; spans that overlap become one. Null texts stay null."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_col).alias("__text"))
    found = find_secrets(rows, model, text_col="__text", **options)
    found = found.withColumns({"__bytes": F.col("__text").cast("binary"), "__over": _running(F.col("spans.last"), F.greatest)})
    cut = lambda a, n: F.substring("__bytes", (a + 1).cast("int"), n.cast("int")).cast("string")
    begun = F.concat(F.array(F.lit(0).cast("long")), "__over")  # where the span before each one ends; a span that begins before is part of it
    parts = F.zip_with("spans", begun, lambda x, at: F.when(x["first"] >= at, F.concat(cut(at, x["first"] - at), F.lit(mark))).otherwise(F.lit("")))
    over = F.try_element_at("__over", F.lit(-1))
    rest = F.concat(F.array_join(parts, ""), cut(over, F.octet_length("__text") - over))
    new = F.when(F.size("spans") > 0, rest).otherwise(F.col("__text"))
    return found.withColumn("__new", new).select(*[F.col("__new").alias(c) if c == text_col else F.col(f"__row.`{c}`") for c in docs.columns])
