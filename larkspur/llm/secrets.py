"""Secret scans: fixed patterns, plus two character Markov models compared by log-likelihood ratio.

All of it is DataFrame expressions: spans come from the lengths of the pieces between matches, a model is a constant
array of weights, and a candidate's score is a fold over its neighbouring characters. Folds that collect do so in chunks,
and strings are read in chunks, so that time stays in proportion to a text's length and to its matches.

Defined results: null and empty texts have no spans; texts are scanned whole, whatever their length; spans that start
together are in order of their kinds; every row of the input gives one row (repeated rows repeat); other columns are passed
through, but columns of the names `base` and `spans` are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: The base kinds in their order, with pattern, and the least length of what counts.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run of these characters is always taken whole, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
MIN_ASSIGN_VALUE = 8

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+"


SPAN, CHUNK, LETTERS = "struct<start:int,kind:int,end:int,value:string>", 256, 4096


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once for each row, however often and in whatever lambda it is used."""
    return F.transform(F.array(value), use)[0]


def scanned(items: Column, zero: Column, after: Callable[[Column, Column], Column], outs: Callable[[Column, Column], Column], kind: str) -> Column:
    """What outs(state, item) gives for all items, as one array of `kind`; after(state, item) is the next state.

    Appending to one growing array would copy it each time, so chunks of items have arrays of their own."""
    none = F.array().cast(f"array<{kind}>")

    def part(state: Column, some: Column) -> Column:
        first = F.struct(state.alias("state"), none.alias("outs"))
        return F.aggregate(some, first, lambda acc, x: F.struct(after(acc["state"], x).alias("state"), F.concat(acc["outs"], outs(acc["state"], x)).alias("outs")))

    def parts(whole: Column) -> Column:
        begin = F.array(F.struct(zero.alias("state"), none.alias("outs")))
        chunks = F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / CHUNK).cast("int"))
        return F.aggregate(chunks, begin, lambda acc, c: F.array_append(acc, part(F.element_at(acc, -1)["state"], F.slice(whole, c * CHUNK + 1, F.lit(CHUNK)))))

    done = once(items, lambda whole: F.when(F.size(whole) > 0, parts(whole)))
    return F.coalesce(F.flatten(F.transform(done, lambda x: x["outs"])), none)


def located(text: Column, pattern: str, matches: Column, kind: int) -> Column:
    """array<SPAN> of the pattern's matches, in code points, end exclusive.

    The i-th match starts after i+1 gaps and i matches, so running lengths of split() and the matches give all places.
    """
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gaps"), matches.alias("matches"))
    begin = lambda pos, x: pos + F.length(x["gaps"])
    end = lambda pos, x: begin(pos, x) + F.length(x["matches"])
    one = lambda pos, x: F.array(F.struct(begin(pos, x).alias("start"), F.lit(kind).alias("kind"), end(pos, x).alias("end"), x["matches"].alias("value")))
    return F.when(F.size(matches) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(scanned(pairs, F.lit(0), end, one, SPAN))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `base`: array<SPAN> of the base kinds, by start, then kind; the value of an assignment is what it assigns."""
    t = F.coalesce(F.col(text), F.lit(""))
    names = [shared.unused(docs, f"_matches{i}") for i in range(4)]
    found = docs.withColumns({n: F.regexp_extract_all(t, F.lit(p), F.lit(0)) for n, p in zip(names, (ASSIGN, ACCESS, HEX), strict=False)})
    found = found.withColumn(names[3], F.when(F.size(names[0]) > 0, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>")))
    places = [located(t, p, F.col(n), i) for i, (n, p) in enumerate(zip(names, (ASSIGN, ACCESS, HEX), strict=False))]
    long_enough = F.transform(
        F.filter(F.arrays_zip(places[0].alias("s"), F.col(names[3]).alias("v")), lambda x: F.length(x["v"]) >= MIN_ASSIGN_VALUE),
        lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["kind"].alias("kind"), x["s"]["end"].alias("end"), x["v"].alias("value")),
    )
    none = F.array().cast(f"array<{SPAN}>")
    base = F.when(F.size(names[0]) + F.size(names[1]) + F.size(names[2]) == 0, none).otherwise(F.array_sort(F.concat(long_enough, places[1], places[2])))
    return found.withColumn("base", base).drop(*names)


def labelled_samples(docs: DataFrame, bound: int = 5_000, made: int = 20_000, text: str = "text") -> DataFrame:
    """Labelled strings (sample, label 1 random or 0 ordinary), about `bound` documents and `made` generated strings.

    Label 1: generated base64, hex and upper-case strings, and the values (not the keywords) that base patterns find. Label 0: the other
    runs of letters, digits and joiners in the same documents, alone and joined to two-part identifiers.
    """
    spark = docs.sparkSession
    some = base_spans(shared.hashed_share(docs.select("doc_id", F.col(text).alias("text")), "doc_id", bound, docs.count()))
    found = some.select(F.explode("base").alias("b")).select(F.col("b")["value"].alias("sample"), F.lit(1).alias("label"))
    # what base patterns match is taken out before ordinary runs are read
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), ASSIGN, " "), ACCESS, " "), HEX, " ")
    runs = F.regexp_extract_all(rest, F.lit(RUN % 4), F.lit(0))
    # each run with the one that follows it, before exploding, so that no row carries the whole list
    follow = F.slice(F.col("runs"), F.lit(2), F.greatest(F.size("runs"), F.lit(1)))
    plain = some.select(runs.alias("runs")).select(F.posexplode(F.arrays_zip(F.col("runs").alias("run"), follow.alias("follow"))).alias("i", "x"))
    run, after = F.col("x")["run"], F.col("x")["follow"]
    joined = F.when((F.col("i") % 4 == 0) & after.isNotNull(), F.concat_ws("_", run, after)).when((F.col("i") % 4 == 2) & after.isNotNull(), F.concat(run, F.initcap(after)))
    plain = plain.select(F.coalesce(joined, run).alias("sample"), F.lit(0).alias("label"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made_up = spark.range(made).select(
        F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 3 == 1, F.regexp_replace(F.base64(F.unhex(digest)), "=", "")).otherwise(F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", ""))).alias("sample"),
        F.lit(1).alias("label"),
    )
    return found.unionByName(plain).unionByName(made_up)


def trained_weights(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """log P(next | character) under label 1 less that under label 0, row by row of the alphabet.

    The counts are aggregated in Spark; at most 2 * 67 * 67 of them come to the driver.
    """
    n = len(ALPHABET)
    pairs = F.transform(F.sequence(F.lit(1), F.length("sample") - 1), lambda i: F.substring(F.col("sample"), i, F.lit(2)))
    counted = samples.filter(F.length("sample") >= 2).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count()
    table = {label: [[smoothing] * n for _ in range(n)] for label in (0, 1)}
    place = {c: i for i, c in enumerate(ALPHABET)}
    for label, pair, count in counted.filter(F.col("pair").rlike(f"^[{ALPHABET[:-2]}=-]{{2}}$")).collect():
        table[label][place[pair[0]]][place[pair[1]]] += count
    log = {label: [[math.log(x / sum(row)) for x in row] for row in rows] for label, rows in table.items()}
    return [round(log[1][i][j] - log[0][i][j], 6) for i in range(n) for j in range(n)]


def log_ratio(value: Column, weights: list[float]) -> Column:
    """Log-likelihood ratio, random against ordinary, of a string over the alphabet."""
    # one foldable expression: an array of thousands of separate literals would bloat the plan
    constant, letters = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>"), F.lit(ALPHABET)

    def step(acc: Column, letter: Column) -> Column:
        code = F.instr(letters, letter)
        return F.struct(code.alias("last"), F.when(acc["last"] == 0, acc["sum"]).otherwise(acc["sum"] + F.element_at(constant, (acc["last"] - 1) * len(ALPHABET) + code)).alias("sum"))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.length(value) - 1) / LETTERS).cast("int")), lambda c: F.substring(value, c * LETTERS + 1, F.lit(LETTERS)))
    return F.aggregate(chunks, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")), lambda acc, part: F.aggregate(F.split(part, ""), acc, step))["sum"]


def beside(runs: Column, base: Column) -> Column:
    """What base spans leave of runs, as array<SPAN>: both, by start, pass by; a run stays open up to what follows it."""
    event = lambda is_run: lambda x: F.struct(x["start"].alias("start"), F.lit(is_run).alias("is_run"), x["end"].alias("end"), x["value"].alias("value"))
    last = F.struct(F.lit((1 << 31) - 1).alias("start"), F.lit(True).alias("is_run"), F.lit((1 << 31) - 1).alias("end"), F.lit("").alias("value"))
    events = F.array_append(F.array_sort(F.concat(F.transform(base, event(False)), F.transform(runs, event(True)))), last)
    zero = F.struct(F.lit(0).alias("cover"), F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value"))

    def after(s: Column, x: Column) -> Column:
        run = x["is_run"]
        return F.struct(
            F.when(run, s["cover"]).otherwise(F.greatest(s["cover"], x["end"])).alias("cover"), F.when(run, F.greatest(x["start"], s["cover"])).otherwise(F.greatest(s["at"], x["end"])).alias("at"),
            F.when(run, x["start"]).otherwise(s["start"]).alias("start"), F.when(run, x["end"]).otherwise(s["end"]).alias("end"), F.when(run, x["value"]).otherwise(s["value"]).alias("value"),
        )

    def outs(s: Column, x: Column) -> Column:
        end = F.least(s["end"], x["start"])
        one = F.struct(s["at"].alias("start"), F.lit(len(KINDS)).alias("kind"), end.alias("end"), F.substring(s["value"], s["at"] - s["start"] + 1, end - s["at"]).alias("value"))
        return F.when(s["at"] < end, F.array(one)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return scanned(events, zero, after, outs, SPAN)


def secret_spans(docs: DataFrame, weights: list[float], text: str = "text", min_run: int = 12, min_ratio: float = 12.0) -> DataFrame:
    """docs with `base` and `spans` (base and model spans by start, then kind; the model's kind is 3).

    The model judges runs of at least min_run letters, digits and joiners, whatever their mix, or what base spans leave of
    them; a ratio of min_ratio nats or more makes a span. Whole texts are scanned.
    """
    t, run = F.coalesce(F.col(text), F.lit("")), RUN % min_run
    some = base_spans(docs, text)
    runs = shared.unused(some, "_runs")
    some = some.withColumn(runs, F.regexp_extract_all(t, F.lit(run), F.lit(0)))
    places = located(t, run, F.col(runs), len(KINDS))
    pieces = F.when((F.size("base") == 0) | (F.size(runs) == 0), places).otherwise(beside(places, F.col("base")))
    judged = F.filter(pieces, lambda x: (F.length(x["value"]) >= 2) & (log_ratio(x["value"], weights) >= min_ratio))
    return some.withColumn("spans", F.array_sort(F.concat(F.col("base"), judged))).drop(runs)


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kind = lambda x: F.element_at(F.array(*map(F.lit, (*KINDS, "model"))), x["kind"] + 1)
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones merged, replaced by a mark."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / LETTERS).cast("int")), lambda c: F.substring(text, c * LETTERS + 1, F.lit(LETTERS)))
    last = F.struct(F.length(text).alias("start"), F.lit(0).alias("kind"), F.length(text).alias("end"), F.lit("").alias("value"))

    def between(parts: Column, a: Column, b: Column) -> Column:
        low, high = lambda c: F.greatest(a, c * LETTERS), lambda c: F.least(b, (c + 1) * LETTERS)
        places = F.sequence(F.floor(a / LETTERS).cast("int"), F.floor((b - 1) / LETTERS).cast("int"))
        return F.when(a < b, F.array_join(F.transform(places, lambda c: F.substring(F.element_at(parts, c + 1), low(c) - c * LETTERS + 1, high(c) - low(c))), "")).otherwise("")

    def done(parts: Column) -> Column:
        outs = lambda pos, x: F.when(x["start"] >= pos, F.array(between(parts, pos, x["start"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return scanned(F.array_append(spans, last), F.lit(0), lambda pos, x: F.greatest(pos, x["end"]), outs, "string")

    pieces = once(once(chunks, done), lambda x: F.array_join(F.slice(x, F.lit(1), F.size(x) - 1), ""))  # without the last one's mark
    return F.when(F.size(spans) == 0, text).otherwise(pieces)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_spans(docs, trained_weights(labelled_samples(docs)))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
