"""End-to-end jobs built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from claimwright import constants as K, schemas
from claimwright.functions import arrays as A, concepts as C, labels as L, text as T
from claimwright.operators import align, cleaning, concept_rows, curate, dedup, metadata, metrics, model, rationale
from claimwright.operators import sampling, split, vocab
from claimwright.session import TEXT_CODEC, settle


def clean_claims(raw: DataFrame, exact_html: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Required fields, sentinels, cleaned text, first copy of each cleaned text.

    The cleaned rows are stored, since the search for copies looks at them twice; of the
    raw columns only ``columns``, if given.
    """
    rows = cleaning.fill_missing(cleaning.drop_missing(raw))
    clean = cleaning.clean_political(rows, exact_html=exact_html)
    if columns is not None:
        clean = clean.select(*columns, "clean_statement")
    clean = settle(clean, codec=TEXT_CODEC)
    return dedup.keep_first(clean, "clean_statement", ["row_id"])


def tag_claims(
    clean: DataFrame, lexicon: C.Lexicon | None = None, length: int = max(K.SEQUENCE_LENGTHS)
) -> DataFrame:
    """Normalised text, tokens and concept tags.

    Tags depend only on earlier tokens, so tagging once at the longest length and
    slicing gives the tags of every shorter one.
    """
    rows = (
        cleaning.normalize_political(clean)
        .withColumn("tokens", T.tokenize(F.col("normalized_text")))
        .withColumn("truncated_tokens", A.head(F.col("tokens"), length))
    )
    return concept_rows.with_tags(rows, "truncated_tokens", lexicon or C.Lexicon(), "concept_tags")


def political_corpus(
    raw: DataFrame, lexicon: C.Lexicon | None = None, seed=K.SEED, columns: list[str] | None = None
) -> DataFrame:
    """Raw political claims to a tagged, split table; the tagged rows are stored once.

    ``columns`` names those of them that are wanted beside ``row_id`` and ``binary_label``. A text
    and its cleaned, normalised and cut forms take five times its space, all stored otherwise.
    """
    own = None if columns is None else [c for c in raw.columns if c in {"row_id", "label", *columns}]
    tagged = tag_claims(clean_claims(raw, columns=own), lexicon)
    tagged = tagged.withColumn("binary_label", L.binary_label(F.col("label")))
    if columns is not None:
        tagged = tagged.select(*dict.fromkeys(["row_id", *columns, "binary_label"]))
    return split.stratified_split(settle(tagged, codec=TEXT_CODEC), ["binary_label"], seed=seed)


def length_tables(corpus: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """The corpus once per length, tokens and tags cut alike."""
    spread = split.length_variants(corpus, "tokens", lengths)
    return spread.withColumn("concept_tags", F.slice("concept_tags", F.lit(1), F.col("L")))


def evaluation_variants(tables: DataFrame) -> DataFrame:
    """Train rows with their concept-only and concept-free token lists."""
    both = F.col("truncated_tokens"), F.col("concept_tags")
    return tables.filter(F.col("split") == "train").withColumns(
        {
            "sufficiency_tokens": A.keep_concept_tokens(*both),
            "comprehensiveness_tokens": A.drop_concept_tokens(*both),
        }
    )


def health_corpus(
    raw: DataFrame, lexicon: C.Lexicon | None = None, length: int = K.SEQUENCE_LENGTHS[0]
) -> DataFrame:
    """Headline snapshots (``row_id, statement, label, subset``) to the concept table.

    Copies go before the costly steps: first exact ones, then those that are
    equal after cleaning. The cleaned rows are stored, since that search looks at them twice.
    """
    rows = dedup.keep_first(cleaning.drop_missing(raw), "statement", ["row_id"])
    clean = dedup.keep_first(settle(cleaning.clean_health(rows)), "clean_statement", ["row_id"])
    tokens = (
        cleaning.normalize_health(clean)
        .withColumn("tokens", T.tokenize(F.col("normalized_text")))
        .withColumn("truncated_tokens", A.head(F.col("tokens"), length))
    )
    kept = cleaning.min_tokens(tokens).withColumns(
        {
            "concept_tags": C.concept_tags(F.col("truncated_tokens"), lexicon),
            "binary_label": F.col("label"),
        }
    )
    return cleaning.without_metadata(kept).select("row_id", *schemas.CONCEPT_COLUMNS, "subset")


def merged_corpus(political: DataFrame, health: DataFrame, seed=K.SEED) -> DataFrame:
    """Both corpora on their shared columns, split jointly by label and source.

    Row ids of the two sources are interleaved so that they stay unique.
    """
    def source(df, name, has_meta):
        marked = cleaning.mark_source(df, name, has_meta)
        return marked.withColumn("row_id", F.col("row_id") * 2 + (1 - has_meta))

    merged, _ = cleaning.union_common(
        source(political.drop("split"), "political", 1), source(health, "health", 0)
    )
    return split.stratified_split(settle(merged), ["binary_label", "dataset_source"], seed=seed)


def encode_splits(corpus: DataFrame, tokens: str, length: int) -> tuple[DataFrame, DataFrame]:
    """Vocabulary fitted on train, and every row's ids."""
    words = settle(vocab.fit_token_vocab(corpus.filter(F.col("split") == "train"), tokens))
    ids = vocab.encode_tokens(corpus, words, tokens, length)
    facts = corpus.select("row_id", "split", "label", "binary_label")
    return words, ids.join(facts, "row_id")


def metadata_features(corpus: DataFrame, csv_nulls: bool = True) -> DataFrame:
    """15 metadata slots per row; vocabularies and scaler see train rows only."""
    train = corpus.filter(F.col("split") == "train")
    vocabs = settle(metadata.fit_vocabs(train, csv_nulls=csv_nulls))
    scaler = settle(metadata.fit_scaler(train))
    return metadata.encode_metadata(corpus, vocabs, scaler, csv_nulls=csv_nulls)


def concept_features(corpus: DataFrame) -> DataFrame:
    """Sub-word alignment and the three channel masks."""
    slots = corpus.withColumn("word_index", A.subword_slots(F.col("truncated_tokens")))
    return align.subword_masks(slots, "concept_tags", "word_index", extra=["word_index"])


def training_table(corpus: DataFrame) -> DataFrame:
    """Tokens, tags, metadata, flag, label and channel scores of every row, stored once."""
    meta = metadata_features(corpus)
    rows = cleaning.with_meta_flag(corpus).withColumn(
        "label", L.encode_label(F.col("binary_label"), unknown=0)
    )
    scores = model.channel_scores("concept_tags")
    rows = rows.select(
        "row_id", "split", "label", "has_meta", "clean_statement", "truncated_tokens",
        "concept_tags", *[c.alias(n) for n, c in scores.items()],
    )
    return settle(align.join_parts([rows, meta]))


def balanced_weights(train: DataFrame, seed: int | None, out: str) -> DataFrame:
    """``(row_id, out)``: copies that balancing by ``seed`` makes of a row, times its class weight.

    Weights stand for repeated rows, so that runs of all seeds share one table. Without a
    seed every row counts once.
    """
    if seed is None:
        copies = train.select("row_id", "label", F.lit(1).alias("_n"))
    else:
        drawn = sampling.balanced_exact(train.select("row_id", "label", "has_meta"), seed=seed)
        copies = drawn.groupBy("row_id", "label").agg(F.count("*").alias("_n"))
    cells = copies.groupBy("label").agg(F.sum("_n").alias("_c"))
    totals = cells.agg(F.sum("_c").alias("_all"), F.count("*").alias("_k"))
    weight = F.col("_n") * F.col("_all") / (F.col("_k") * F.col("_c"))
    sized = cells.crossJoin(totals)  # one row beside one row a class
    return copies.join(F.broadcast(sized), "label").select("row_id", weight.alias(out))


def train_runs(table: DataFrame, runs: list[tuple[int, bool]], balance: bool = True, grid: tuple = (0.001, 0.01, 0.1)):
    """Fits the runs ``(seed, use_meta)`` together; for each the best model of the grid and its val score."""
    # Texts and tags stay behind: the joins move what the fits read.
    train = table.filter(F.col("split") == "train").select("row_id", "label", "has_meta", "truncated_tokens", "meta")
    seeds = sorted({seed for seed, _ in runs}) if balance else [None]
    for k, seed in enumerate(seeds):
        train = train.join(balanced_weights(table.filter(F.col("split") == "train"), seed, f"_w{k}"), "row_id", "left")
    train = settle(train)
    column = {seed: f"_w{seeds.index(seed if balance else None)}" for seed, _ in runs}
    named = {f"{seed}-{use_meta}": (column[seed], use_meta) for seed, use_meta in runs}
    best = model.fit_best(train, table.filter(F.col("split") == "val"), named, grid=grid)
    return [best[f"{seed}-{use_meta}"] for seed, use_meta in runs]


def train_and_score(
    corpus: DataFrame,
    balance: bool = True,
    grid: tuple = (0.001, 0.01, 0.1),
    use_meta: bool = True,
    seed: int = K.SEED,
    table: DataFrame | None = None,
):
    """Fit on (balanced) train, choose on val, score test: ``(model, val score, scored test)``.

    ``seed`` decides which rows the balancing repeats; ``use_meta`` switches the metadata
    features. ``table`` is the ``training_table`` of ``corpus`` where it is known already.
    """
    table = training_table(corpus) if table is None else table
    ((fitted, score),) = train_runs(table, [(seed, use_meta)], balance, grid)
    return fitted, score, model.score_rows(fitted, table.filter(F.col("split") == "test"))


def result_record(scored: DataFrame, val_score: float, **facts) -> DataFrame:
    """One run record: overall and per-domain test metrics plus the given facts."""
    report = metrics.domain_report(scored)
    per_domain = F.map_from_entries(
        F.collect_list(  # at most two domains
            F.when(
                F.col("domain") != "overall",
                F.struct(
                    F.col("domain"),
                    F.struct("n", F.col("accuracy").alias("acc"), "macro_f1"),
                ),
            )
        )
    )
    overall = F.col("domain") == "overall"
    return report.agg(
        *[F.lit(v).alias(k) for k, v in facts.items()],
        F.lit(float(val_score)).alias("best_val_macro_f1"),
        F.max(F.when(overall, F.col("accuracy"))).alias("test_acc"),
        F.max(F.when(overall, F.col("macro_f1"))).alias("test_macro_f1"),
        per_domain.alias("test_per_domain"),
    ).crossJoin(metrics.channel_means(scored))  # one row each


def attention_rows(scored: DataFrame, tokens: str = "truncated_tokens", tags: str = "concept_tags") -> DataFrame:
    """Long ``(row_id, channel, pos, word, alpha, real)`` from row-local attention.

    A word's score is its length, a stand-in for a trained head; attention is the
    softmax over the words of the channel.
    """
    strength = F.transform(F.col(tokens), lambda t: F.length(t) / 4)
    weights = [
        F.struct(
            F.lit(c).alias("channel"),
            A.masked_softmax(strength, A.channel_mask(F.col(tags), c)).alias("alpha"),
        )
        for c in K.CHANNELS
    ]
    long = scored.select("row_id", F.col(tokens).alias("words"), F.explode(F.array(*weights)).alias("c"))
    return long.select(
        "row_id",
        F.col("c.channel").alias("channel"),
        F.posexplode_outer(
            F.arrays_zip(F.col("words").alias("word"), F.col("c.alpha").alias("alpha"))
        ).alias("pos", "z"),
    ).filter(F.col("pos").isNotNull()).select(
        "row_id", "channel", "pos", "z.word", "z.alpha", F.lit(1).alias("real")
    )


def attribution_rows(scored: DataFrame, fitted, tokens: str = "truncated_tokens", tags: str = "concept_tags") -> DataFrame:
    """As ``attention_rows``, by what each word adds to the log odds of the predicted class."""
    adds = model.attributions(fitted, scored, tokens)
    masks = F.array(*[F.struct(F.lit(c).alias("channel"), A.channel_mask(F.col(tags), c).alias("mask")) for c in K.CHANNELS])
    inside = scored.select("row_id", F.explode(masks).alias("c")).select("row_id", "c.channel", F.posexplode("c.mask").alias("pos", "in"))
    # One channel of one text, at most as many rows as it has words.
    own = Window.partitionBy("row_id", "channel")
    weight = F.when(F.col("in") > 0, F.exp("adds"))
    both = inside.join(adds, ["row_id", "pos"]).withColumn("_w", weight)
    alpha = F.coalesce(F.col("_w") / F.sum("_w").over(own), F.lit(0.0))
    return both.select("row_id", "channel", "pos", "word", alpha.alias("alpha"), F.lit(1).alias("real"))


def curated_cards(scored: DataFrame, n: int = 8, fitted=None) -> DataFrame:
    """Cards of ``n`` good examples spread over domains and classes.

    With the model that scored them, words rank by what they added to its verdict.
    """
    chosen = curate.round_robin(curate.good_examples(scored), n)
    ranked = attention_rows(chosen) if fitted is None else attribution_rows(settle(chosen), fitted)
    tops = rationale.top_words_long(ranked, ["row_id", "channel"])
    best = F.array_sort(
        F.collect_list(F.struct("nth", "word", "alpha"))  # at most four words
    )
    lists = tops.groupBy("row_id", "channel").agg(best.alias("words"))
    wide = lists.groupBy("row_id").pivot("channel", K.CHANNELS).agg(F.first("words"))
    cards = chosen.join(wide, "row_id", "left").withColumnRenamed("clean_statement", "claim")
    none = F.array().cast("array<struct<nth:int,word:string,alpha:double>>")
    formatted = {
        short: curate.format_words(F.coalesce(F.col(channel), none))
        for channel, short in (("emotion", "em"), ("modality", "mo"), ("negation", "ne"))
    }
    return cards.select(
        "example", "row_id", "domain", "label", "pred", curate.card_text(formatted).alias("card")
    )
