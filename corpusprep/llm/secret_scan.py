r"""Secret scans with character Markov models. DataFrame and SQL functions only.

Three patterns find assigned secrets, access keys and long hexadecimal strings.
Beyond them, every long token of key characters is scored by two first-order
character models: one of random strings, one of ordinary identifiers. The sum of
log-likelihood ratios of its transitions, in all and per transition, decides.

The models learn from samples that the patterns label: values that they find,
and words of documents in which they find nothing. Both samples are bounded and
drawn by hash. Unseen transitions are more likely in a random string, so the
random model is smoothed by more than the ordinary one.

Positions are code points: a text is split at a pattern's matches, and a running
sum of the lengths of its pieces and matches gives the places. Only lengths
and matches are kept, one row for each match, so a text with very many is
handled row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.session import materialize

#: Kinds in the order in which they are listed.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
ASSIGNED = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(.*)$"""
MIN_ASSIGNED = 6

#: Characters of keys; tokens scored are runs of at least MIN_TOKEN of them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
#: Words that the ordinary model learns from.
IDENTIFIER = r"[A-Za-z0-9+/_=-]{4,}"

#: Bounds of the training samples: values found by the patterns, and documents without any.
TRAIN_SECRETS = 50_000
TRAIN_DOCS = 20_000
RANDOM_SMOOTHING = 1.0
ORDINARY_SMOOTHING = 0.05
#: Least log-likelihood ratio in all, and per transition, of a token reported.
MIN_LLR = 25.0
MIN_MEAN_LLR = 1.0
SEED = 11
MARKOV = "markov"


def _draw(*cols: Column) -> Column:
    """Even number below 1 from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *cols), 11) / float(1 << 53)


def pattern_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid (of the row), doc_id, key, kind, start, end, value: matches of all patterns and tokens.

    A row without any has one with a null kind. A null text is empty.
    """
    doc_id, text = F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), doc_id.alias("doc_id"), F.xxhash64(doc_id, F.col(text_col).cast("string")).alias("key"), text.alias("text")
    )

    def found(kind: str, pattern: str) -> Column:
        matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        gaps = F.transform(F.split("text", pattern, -1), F.char_length)
        return F.when(
            F.col("text").rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.arrays_zip(gaps.alias("gap"), matches.alias("value")).alias("m"))
        )

    kinds = F.array_compact(F.array(*(found(k, p) for k, p in {**PATTERNS, MARKOV: TOKEN}.items())))
    by_kind = rows.select("uid", "doc_id", "key", F.explode_outer(kinds).alias("k")).select("uid", "doc_id", "key", "k.kind", F.posexplode_outer("k.m").alias("pos", "m"))
    # the last gap has no match after it
    flat = by_kind.select("uid", "doc_id", "key", "kind", "pos", "m.gap", "m.value").where(F.col("kind").isNull() | F.col("value").isNotNull())
    so_far = Window.partitionBy("uid", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("value")
    placed = flat.withColumn("end", F.sum(F.col("gap") + size).over(so_far)).withColumn("start", F.col("end") - size)
    kept = F.when(F.col("kind") == "assign", F.regexp_extract("value", ASSIGNED, 1)).otherwise(F.col("value"))
    return placed.select("uid", "doc_id", "key", "kind", "start", "end", kept.alias("value"))


def _reported(matches: DataFrame) -> Column:
    return F.col("kind").isin("access", "hex") | ((F.col("kind") == "assign") & (F.char_length("value") >= MIN_ASSIGNED))


def _bigrams(tokens: DataFrame, *keep: str) -> DataFrame:
    """keep and each pair of neighbouring characters of ``value``, both of them in the alphabet."""
    place = F.explode(F.sequence(F.lit(1), F.char_length("value") - 1)).alias("_at")
    pairs = tokens.where(F.char_length("value") > 1).select(*keep, "value", place)
    return pairs.select(*keep, F.substring("value", F.col("_at"), 2).alias("pair")).where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))


def transition_scores(random: DataFrame, ordinary: DataFrame) -> DataFrame:
    """pair, llr: log-likelihood ratio of every transition of the alphabet (a row for each pair of its characters).

    random, ordinary: ``value`` of labelled strings.
    """
    spark = random.sparkSession
    counts = _bigrams(random.select("value", F.lit(1).alias("r"), F.lit(0).alias("o")), "r", "o").unionByName(
        _bigrams(ordinary.select("value", F.lit(0).alias("r"), F.lit(1).alias("o")), "r", "o")
    ).groupBy("pair").agg(F.sum("r").alias("r"), F.sum("o").alias("o"))
    chars = spark.range(1).select(F.explode(F.array(*map(F.lit, ALPHABET))).alias("first"))
    pairs = chars.select("first", F.explode(F.array(*map(F.lit, ALPHABET))).alias("second"))
    table = pairs.select("first", F.concat("first", "second").alias("pair")).join(counts, "pair", "left").fillna(0, ["r", "o"])
    around = Window.partitionBy("first")
    size = len(ALPHABET)

    def log_likelihood(n: str, smoothing: float) -> Column:
        return F.log((F.col(n) + smoothing) / (F.sum(n).over(around) + smoothing * size))

    return table.select("pair", (log_likelihood("r", RANDOM_SMOOTHING) - log_likelihood("o", ORDINARY_SMOOTHING)).alias("llr"))


def learn(docs: DataFrame, matches: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``transition_scores`` learned from samples of what the patterns found, and of documents without a match."""
    random = matches.where(_reported(matches))
    text = F.col(text_col).cast("string")
    clean = ~F.coalesce(text, F.lit("")).rlike("|".join(PATTERNS.values()))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), _draw(F.col(id_col), text).alias("draw"))
    sizes = matches.agg(F.count(F.when(_reported(matches), 1)).alias("secrets"), F.count_distinct("uid").alias("docs")).first()
    # by the row's key, not its uid, which depends on how files are split
    random = random.where(_draw(F.col("key"), F.col("kind"), F.col("start")) < min(1.0, TRAIN_SECRETS / max(1, sizes["secrets"])))
    some = rows.where((F.col("draw") < min(1.0, TRAIN_DOCS / max(1, sizes["docs"]))) & clean)
    ordinary = some.select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("value"))
    return transition_scores(random.select("value"), ordinary)


def scored_tokens(matches: DataFrame, scores: DataFrame) -> DataFrame:
    """uid, doc_id, key, start, end, llr, mean of the tokens among the matches."""
    tokens = matches.where(F.col("kind") == MARKOV)
    # a row for each pair of characters of the alphabet: 4,489 of them
    pairs = _bigrams(tokens, "uid", "doc_id", "key", "start", "end").join(F.broadcast(scores), "pair")
    return pairs.groupBy("uid", "doc_id", "key", "start", "end").agg(F.sum("llr").alias("llr"), F.avg("llr").alias("mean"))


def _joined(spans: Column) -> Column:
    line = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(line, ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (hash of id and text), n_assign, n_access, n_hex, base_spans, spans.

    Spans are (start, rank of the kind, kind, end), sorted, in code points with the end exclusive; base_spans
    are those of the patterns alone. Each row of ``docs`` has a row, repeated rows too. A null text is empty.
    """
    matches = materialize(pattern_matches(docs, id_col, text_col))
    scores = materialize(learn(docs, matches, id_col, text_col))
    markov = scored_tokens(matches, scores).where((F.col("llr") >= MIN_LLR) & (F.col("mean") >= MIN_MEAN_LLR))
    rank = F.lit(len(PATTERNS))
    for i, kind in enumerate(PATTERNS):
        rank = F.when(F.col("kind") == kind, i).otherwise(rank)
    own = matches.select(
        "uid", "doc_id", "key", F.when(_reported(matches), F.struct("start", rank.alias("rank"), "kind", "end")).alias("span")
    )
    extra = markov.select(
        "uid", "doc_id", "key", F.struct("start", F.lit(len(PATTERNS)).alias("rank"), F.lit(MARKOV).alias("kind"), "end").alias("span")
    )
    grouped = own.unionByName(extra).groupBy("uid", "doc_id", "key").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return grouped.select(
        "doc_id", "key", *(count(k).alias(f"n_{k}") for k in PATTERNS),
        F.filter("spans", lambda s: s["kind"] != MARKOV).alias("base_spans"), "spans",
    )


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = scan_secrets(docs, id_col, text_col)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


#: Characters of a chunk of text; places in a chunk are found by counting from its start.
CHUNK = 1024


def _cuts_by_chunk(found: DataFrame) -> DataFrame:
    """_key, _id, _cut: for each chunk with something to mask, its number and the pieces (from, to, whether a mask stands for it)."""
    spans = found.select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"), F.inline("spans")).select("_key", "_id", "start", "end")
    in_order = Window.partitionBy("_key", "_id").orderBy("start", "end")
    reach = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    # spans that overlap or touch are one
    opened = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    runs = opened.withColumn("run", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("_key", "_id", "run").agg(F.min("start").alias("lo"), F.max("end").alias("hi")).where("hi > lo")
    chunk = F.explode(F.sequence(F.floor(F.col("lo") / CHUNK), F.floor((F.col("hi") - 1) / CHUNK))).alias("chunk")
    pieces = runs.select("_key", "_id", "lo", "hi", chunk).select(
        "_key", "_id", F.col("chunk").cast("int").alias("chunk"),
        F.struct(
            F.greatest(F.col("lo") - F.col("chunk") * CHUNK, F.lit(0)).cast("int").alias("a"),
            F.least(F.col("hi") - F.col("chunk") * CHUNK, F.lit(CHUNK)).cast("int").alias("b"), (F.col("lo") >= F.col("chunk") * CHUNK).alias("first"),
        ).alias("piece"),
    )
    chunks = pieces.groupBy("_key", "_id", "chunk").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return chunks.groupBy("_key", "_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "pieces"))).alias("_cut"))


#: The text of ``_chunks`` with ``_mask`` for the pieces of ``_cut``: chunks without any are joined as they are.
_MASKED = """
concat(array_join(transform(_cut, (x, i) -> concat(
  array_join(slice(_chunks, IF(i = 0, -1, _cut[i - 1].chunk) + 2, x.chunk - IF(i = 0, -1, _cut[i - 1].chunk) - 1), ''),
  array_join(transform(x.pieces, (p, j) -> concat(
    substring(_chunks[x.chunk], IF(j = 0, 0, x.pieces[j - 1].b) + 1, p.a - IF(j = 0, 0, x.pieces[j - 1].b)), IF(p.first, _mask, ''))), ''),
  substring(_chunks[x.chunk], element_at(x.pieces, -1).b + 1))), ''),
  array_join(slice(_chunks, element_at(_cut, -1).chunk + 2, size(_chunks)), ''))"""


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span found replaced by ``mask``; overlapping and touching ones are one. Documents without secrets are as before.

    length_col: a column that holds the text's length, brought up to date where the text changes.
    """
    found = scan_secrets(docs, id_col, text_col).select("key", "doc_id", "spans").where(F.size("spans") > 0).dropDuplicates(["key", "doc_id"])
    cuts = _cuts_by_chunk(found)
    # the table's columns go into a struct, so none can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    key = F.xxhash64(F.col(f"_row.`{id_col}`"), F.col(f"_row.`{text_col}`").cast("string"))
    joined = rows.join(cuts, (key == F.col("_key")) & F.col(f"_row.`{id_col}`").eqNullSafe(F.col("_id")), "left")
    text = F.col(f"_row.`{text_col}`").cast("string")
    joined = joined.withColumn("_chunks", F.when(F.col("_cut").isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))
    joined = joined.withColumn("_mask", F.lit(mask))
    masked = F.when(F.col("_cut").isNull(), text).otherwise(F.expr(_MASKED))
    out = joined.withColumn("_text", masked)
    cols = []
    for c in docs.columns:
        value = F.col(f"_row.`{c}`")
        if c == text_col:
            value = F.col("_text")
        elif c == length_col:
            value = F.when(F.col("_cut").isNull(), value).otherwise(F.char_length("_text").cast(docs.schema[c].dataType))
        cols.append(value.alias(c))
    return out.select(*cols)
