"""Secret scans with character Markov models, in DataFrame functions only.

Two models of character pairs, one of random strings and one of ordinary
identifiers, are counted from labelled samples. A candidate (a run of
``CANDIDATE``) is a secret if its mean log-likelihood ratio per pair, random
over ordinary, exceeds ``MARGIN``. Three base patterns are always reported;
the models add spans of kind ``markov`` that aren't within one of theirs.

Shorter runs, and runs joined by '.' and '-', have a second pair of models
(``models`` gives both). Its ordinary strings are whole runs, so that numbers,
addresses and dotted names count as ordinary. It is read for each ``PIECE`` and
each ``RUN`` of ``LEAST`` characters or more, and its margin rises for short
ones (``margin``). Of markov spans only those within no other are kept.

Matches and the text between them come from one regular expression each, and
positions are running sums of their lengths in code points: everything stays
in the JVM, row by row, without a shuffle. Rows that a pattern doesn't touch
cost one search for it.

``labelled_samples`` takes the labels from the base patterns: matched values
are random strings, from at most ``SAMPLE_DOCS`` documents that hold a match, and
words outside matches ordinary identifiers, from as many documents of any kind
(each time the first by a hash of their id). Counting
is a grouped aggregate; the driver gets one number for each character pair
(4,356 at most for each model). Rare pairs fall back on single characters. With
fewer than ``LEAST_SAMPLES`` strings of a class there is nothing to compare:
the model then takes nothing for random, and no markov spans are added.

Null text is empty; without matches the list of spans is empty. Rows are
independent, so repeated rows and empty tables need no case of their own.
Extra columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.llm.common import bounded_sample_ids

# The base patterns. The last two are held to their least length
# in the pattern, which leaves the same matches as dropping shorter ones.
ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
ASSIGN_LENGTH = 8
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
CANDIDATE = r"[A-Za-z0-9+/_=]{20,}+"
WORD = r"[A-Za-z_][A-Za-z0-9_]{2,}"
RUN_ALPHABET = ALPHABET + ".-"
LEAST = 12
PIECE = r"(?<![A-Za-z0-9+/_=])[A-Za-z0-9+/_=]{12,}+"      # looking behind saves a try at each character
RUN = r"(?<![A-Za-z0-9+/_=])[A-Za-z0-9+/_=][A-Za-z0-9+/_=.-]{10,}[A-Za-z0-9+/_=]"
RUN_WORD = r"[A-Za-z0-9+/_=][A-Za-z0-9+/_=.-]*[A-Za-z0-9+/_=]"
SAMPLE_DOCS = 1000
LEAST_SAMPLES = 20
NOTHING = -1.0                         # ratio of every pair in a model that finds nothing
MARGIN = 0.5
PRIOR = {True: 40.0, False: 4.0}       # weight of the single-character model for each first character

SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _matches(text: Column, kind: str, pattern: str, keep=None) -> Column:
    """All matches of ``pattern`` as spans, by start; ``keep(match)`` drops failing ones."""
    none = F.array().cast(SPAN)
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["pos"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
                                F.lit(kind).alias("kind"), end.alias("end")))
        kept = span if keep is None else F.when(keep(pair["hit"]), span).otherwise(none)
        return F.struct(end.alias("pos"), F.concat(acc["out"], kept.cast(SPAN)).alias("out"))

    pairs = F.slice(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), 1, F.size(hits))
    zero = F.struct(F.lit(0).cast("bigint").alias("pos"), none.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(none)


def _long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= ASSIGN_LENGTH


def base_spans(text: Column) -> Column:
    """Spans of the base patterns, kind by kind."""
    return F.concat(_matches(text, "assign", ASSIGN, _long_value), _matches(text, "access", ACCESS), _matches(text, "hex", HEX))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _sampled(rows: DataFrame, limit: int) -> DataFrame:
    """The rows of at most ``limit`` ids."""
    ids = bounded_sample_ids(rows.select("doc_id"), limit)
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id")


def sampled_rows(docs: DataFrame, limit: int = SAMPLE_DOCS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of at most ``limit`` documents that hold a base match, and of as many of any kind."""
    rows = _rows(docs)
    holds = F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX)
    return _sampled(rows.where(holds), limit), _sampled(rows, limit)


def labelled_samples(docs: DataFrame, limit: int = SAMPLE_DOCS, word: str = WORD,
                     chosen: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(sample, is_random) from the base matches and other words of ``chosen`` (by default ``sampled_rows``)."""
    holding, others = chosen or sampled_rows(docs, limit)
    values = F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LENGTH)
    random = F.concat(values, F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = F.regexp_extract_all(rest, F.lit(word), F.lit(0))
    return (holding.select(F.explode(random).alias("sample"), F.lit(True).alias("is_random"))
            .unionByName(others.select(F.explode(ordinary).alias("sample"), F.lit(False).alias("is_random"))))


def train(samples: DataFrame, alphabet: str = ALPHABET) -> list[float]:
    """Log-likelihood ratio of each pair of ``alphabet`` characters, from (sample, is_random) rows."""
    pairs = (samples.where(F.length("sample") >= 2)
             .select("is_random", F.explode(F.concat(F.array(F.lit("")), F.transform(       # "" counts the strings
                 F.sequence(F.lit(1), F.length("sample") - 1), lambda i: F.col("sample").substr(i, F.lit(2))))).alias("pair")))
    known = F.col("pair").rlike(f"^([{alphabet}]{{2}})?$")
    counts = {(r[0], r[1]): r[2] for r in pairs.where(known).groupBy("is_random", "pair").count().collect()}
    if min(counts.get((kind, ""), 0) for kind in (True, False)) < LEAST_SAMPLES:
        return [NOTHING] * len(alphabet) ** 2
    single = {}                        # share of each second character, whatever the first
    for kind in (True, False):
        own = [1 + sum(counts.get((kind, a + b), 0) for a in alphabet) for b in alphabet]
        single[kind] = [x / sum(own) for x in own]
    out = []
    for a in alphabet:
        rows = {}
        for kind in (True, False):
            own = [counts.get((kind, a + b), 0) + PRIOR[kind] * single[kind][i] for i, b in enumerate(alphabet)]
            rows[kind] = [log(x / sum(own)) for x in own]
        out += [x - y for x, y in zip(rows[True], rows[False])]
    return out


def models(docs: DataFrame) -> tuple[list[float], list[float]]:
    """The models of ``CANDIDATE`` and of ``PIECE`` and ``RUN``, from the same documents."""
    chosen = sampled_rows(docs)
    return train(labelled_samples(docs, chosen=chosen)), train(labelled_samples(docs, word=RUN_WORD, chosen=chosen), RUN_ALPHABET)


def ratio(token: Column, model: list[float], alphabet: str = ALPHABET) -> Column:
    """Mean log-likelihood ratio per character pair of a run of ``alphabet`` characters."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")   # folded to a constant
    place = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    total = F.aggregate(
        F.slice(place, 2, F.length(token)), F.struct(F.lit(0.0).alias("sum"), F.element_at(place, 1).alias("last")),
        lambda acc, x: F.struct((acc["sum"] + F.element_at(table, acc["last"] * len(alphabet) + x + 1)).alias("sum"), x.alias("last")),
        lambda acc: acc["sum"])
    return total / (F.length(token) - 1)


def margin(token: Column) -> Column:
    """MARGIN, raised below 20 characters as the deviation of a mean over fewer pairs."""
    return F.lit(MARGIN) * F.sqrt(F.greatest(F.lit(1.0), F.lit(19.0) / (F.length(token) - 1)))


def scan(docs: DataFrame, model: list[float], runs: list[float] | None = None) -> DataFrame:
    """doc_id, base and spans of each row of ``docs(doc_id, text)``.

    ``model`` and ``runs`` are those of ``models``; without ``runs`` only
    ``CANDIDATE`` is scored.

    Spans are (start, rank, kind, end), by start, then kind as in KINDS; code
    points, end exclusive. ``base`` holds the base patterns' spans only.
    """
    return _with_spans(_rows(docs), model, runs).select("doc_id", "base", "spans")


def _markov(text: Column, model: list[float], runs: list[float] | None) -> Column:
    """Spans that a model takes for random."""
    if runs is None:
        return _matches(text, "markov", CANDIDATE, lambda token: ratio(token, model) > MARGIN)

    def random(token: Column) -> Column:
        return ratio(token, runs, RUN_ALPHABET) > margin(token)

    pieces = _matches(text, "markov", PIECE, lambda token: random(token) | (token.rlike(f"^{CANDIDATE}$") & (ratio(token, model) > MARGIN)))
    joined = _matches(text, "markov", RUN, lambda token: token.rlike("[.-]") & random(token))
    return F.concat(joined, pieces)


def _with_spans(rows: DataFrame, model: list[float], runs: list[float] | None) -> DataFrame:
    found = rows.withColumn("base", F.array_sort(base_spans(F.col("text")))).withColumn("extra", _markov(F.col("text"), model, runs))
    within = lambda m, o: (o["start"] <= m["start"]) & (m["end"] <= o["end"])
    whole = F.filter("extra", lambda m: ~F.exists("base", lambda b: within(m, b)) & ~F.exists("extra", lambda o: within(m, o) & (o != m)))
    return found.withColumn("spans", F.array_sort(F.concat(F.col("base"), whole))).drop("extra")


def redact(docs: DataFrame, model: list[float], mark: str = "[SECRET]", runs: list[float] | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; overlapping spans give one mark."""
    kept = F.col("text")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")      # apart from the names used here
    rows = _with_spans(docs.select(whole, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), model, runs)
    zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        gap = F.array(F.substring(kept, (acc["pos"] + 1).cast("int"), (span["start"] - acc["pos"]).cast("int")), F.lit(mark))
        out = F.when(span["start"] >= acc["pos"], F.concat(acc["out"], gap)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], span["end"]).alias("pos"), out.alias("out"))

    clean = F.aggregate("spans", zero, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(kept, (acc["pos"] + 1).cast("int"), F.length(kept))))
    text = F.when(F.size("spans") > 0, clean).otherwise(F.col("row.text"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
