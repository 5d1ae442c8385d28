"""Concept tags with a lexicon table of any size and scopes of any length.

Texts are cut into chunks of tokens. A chunk looks its distinct tokens up by a join and
keeps the few that the lexicon has. Scope is a walk with ``steps`` slots, "a cue with so many
steps left". What a chunk does to the slots it is given has a short form: whether it holds a
boundary, how many content tokens move the slots on, and the slots it makes from empty ones.
These forms are composed along a text, which gives each chunk its true start, and a
second walk gives the tags. Tokens are never sorted, and a long text is as many rows as it
has chunks. ``tag_table`` does the same on exploded tokens by two windows, for three steps and
texts of common length, where it is faster. :mod:`claimwright.functions.concepts` does the same inside a row, with no
shuffle, for word lists that fit into a plan and three steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimwright.functions import concepts as C
from claimwright.functions.arrays import let
from claimwright.functions.text import PUNCT_TOKEN
from claimwright.operators.vocab import explode_tokens
from claimwright.session import broadcast_if_small, settle

MAX_BROADCAST_TERMS = 1_000_000
CHUNK = 256
_KIND_NAMES = ("content", "boundary", "skip")


def lexicon_table(spark, lexicon: C.Lexicon) -> DataFrame:
    """``(category, term)`` rows of a lexicon."""
    lists = {
        "EMOTION": lexicon.emotion, "NEGATION": lexicon.negation,
        "MODALITY": lexicon.modality, "SKIP": lexicon.skip, "BOUNDARY": lexicon.boundaries,
    }
    rows = [(category, term) for category, terms in lists.items() for term in dict.fromkeys(terms)]
    return spark.createDataFrame(rows, "category string, term string")


def _lookup(lexicon: DataFrame) -> DataFrame:
    """``(look, cls)``: ``k`` and a key with its cue plus 20 if skipped, ``b`` and a boundary token."""
    def flag(name):
        return F.max((F.col("category") == name).cast("int")) == 1

    cue = F.when(flag("EMOTION"), C.EMOTION).when(flag("NEGATION"), C.NEGATION).when(flag("MODALITY"), C.MODALITY).otherwise(0)
    keys = lexicon.filter(F.col("category") != "BOUNDARY").groupBy(F.concat(F.lit("k"), "term").alias("look")).agg(
        (cue + F.when(flag("SKIP"), C.SKIP).otherwise(0)).alias("cls")
    )
    marks = lexicon.filter(F.col("category") == "BOUNDARY").select(F.concat(F.lit("b"), "term").alias("look"), F.lit(C.BOUNDARY).alias("cls"))
    return broadcast_if_small(keys.unionByName(marks.distinct()), MAX_BROADCAST_TERMS)


def chunks(df: DataFrame, tokens: str, key: str = "row_id", size: int = CHUNK) -> DataFrame:
    """``(key, chunk, tokens)``; a text without tokens has none."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(size))
    parts = F.transform(starts, lambda i: F.slice(tokens, i, F.lit(size)))
    rows = df.select(key, F.posexplode_outer(parts).alias("chunk", "tokens"))
    return rows.filter(F.size("tokens") > 0)


def classified(parts: DataFrame, lexicon: DataFrame, key: str = "row_id", negation_suffix: str = "n't") -> DataFrame:
    """Adds ``classes`` to chunks: cue type plus 0, 10 or 20 for content, boundary and skip tokens."""
    looks = F.array_distinct(
        F.flatten(F.transform("tokens", lambda t: F.array(F.concat(F.lit("k"), C.token_key(t)), F.concat(F.lit("b"), t))))
    )
    asked = parts.select(key, "chunk", F.explode(looks).alias("look"))
    # At most as many entries as a chunk has tokens, twice.
    found = asked.join(_lookup(lexicon), "look").groupBy(key, "chunk").agg(F.map_from_entries(F.collect_list(F.struct("look", "cls"))).alias("_found"))

    def of(token: Column) -> Column:
        return let(
            C.token_key(token),
            lambda k: let(
                F.coalesce(F.col("_found")[F.concat(F.lit("k"), k)], F.lit(0)),
                lambda w: F.when(w % 10 == C.EMOTION, C.EMOTION)
                .when((w % 10 == C.NEGATION) | k.endswith(negation_suffix), C.NEGATION)
                .otherwise(w % 10)
                + F.when(F.col("_found")[F.concat(F.lit("b"), token)].isNotNull(), C.BOUNDARY)
                .when((w >= C.SKIP) | token.rlike(PUNCT_TOKEN), C.SKIP)
                .otherwise(C.CONTENT),
            ),
        )

    return parts.join(found, [key, "chunk"], "left").select(key, "chunk", "tokens", F.transform("tokens", of).alias("classes"))


def _empty(steps: int) -> Column:
    return F.array(*[F.lit(0)] * steps)


def walk(classes: Column, slots: Column, steps: int) -> Column:
    """``slots`` after the tokens, and ``reach``: for each content token the type of the earliest cue that covers it."""

    def step(acc: Column, cls: Column) -> Column:
        content, boundary = cls < C.BOUNDARY, (cls >= C.BOUNDARY) & (cls < C.SKIP)
        earliest = F.coalesce(F.get(F.filter(acc["slots"], lambda s: s > 0), F.lit(0)), F.lit(0))
        cue = F.when(cls % 10 >= C.NEGATION, cls % 10).otherwise(0)
        moved = (
            F.when(content, F.concat(F.slice(acc["slots"], 2, steps - 1), F.array(F.lit(0))))
            .when(boundary, _empty(steps))
            .otherwise(acc["slots"])
        )
        return let(
            moved,
            lambda m: F.struct(
                F.concat(F.slice(m, 1, steps - 1), F.array(F.when(F.get(m, F.lit(steps - 1)) > 0, F.get(m, F.lit(steps - 1))).otherwise(cue))).alias("slots"),
                F.concat(acc["reach"], F.array(F.when(content, earliest).otherwise(0))).alias("reach"),
            ),
        )

    return F.aggregate(classes, F.struct(slots.alias("slots"), F.array().cast("array<int>").alias("reach")), step)


def composed(slots: Column, chunk: Column, steps: int) -> Column:
    """Slots after a chunk, from those before it and the chunk's ``resets, moves, own``."""
    moved = F.concat(F.slice(slots, chunk["moves"] + 1, F.lit(steps)), F.array_repeat(F.lit(0), chunk["moves"]))
    older_first = F.zip_with(moved, chunk["own"], lambda a, b: F.when(a > 0, a).otherwise(b))
    return F.when(chunk["resets"], chunk["own"]).otherwise(older_first)


def chunk_starts(parts: DataFrame, key: str = "row_id", steps: int = 3) -> DataFrame:
    """``(key, chunk, slots)`` of the chunks that start inside a scope.

    Only the short forms of a text's chunks meet, one small row for each chunk.
    """
    moves = F.size(F.filter("classes", lambda c: c < C.BOUNDARY))
    forms = parts.select(
        key,
        F.struct(
            "chunk",
            F.exists("classes", lambda c: (c >= C.BOUNDARY) & (c < C.SKIP)).alias("resets"),
            F.least(moves, F.lit(steps)).alias("moves"),
            walk(F.col("classes"), _empty(steps), steps)["slots"].alias("own"),
        ).alias("form"),
    )
    along = forms.groupBy(key).agg(F.sort_array(F.collect_list("form")).alias("forms")).where(F.size("forms") > 1)
    none = F.array().cast("array<struct<chunk:int,slots:array<int>>>")
    starts = F.aggregate(
        "forms",
        F.struct(_empty(steps).alias("slots"), none.alias("starts")),
        lambda acc, form: F.struct(
            composed(acc["slots"], form, steps).alias("slots"),
            F.concat(acc["starts"], F.array(F.struct(form["chunk"].alias("chunk"), acc["slots"].alias("slots")))).alias("starts"),
        ),
        lambda acc: F.filter(acc["starts"], lambda s: F.exists(s["slots"], lambda x: x > 0)),
    )
    return along.select(key, F.inline(starts))


def tag_table_by_chunks(
    df: DataFrame, tokens: str, lexicon: DataFrame, key: str = "row_id", steps: int = 3, size: int = CHUNK
) -> DataFrame:
    """``(key, pos, token, cue, kind, reach, tag)`` of every token; ``key`` names a row.

    ``reach`` is the type of the earliest cue within ``steps`` content tokens before a content
    token and after the last boundary. A null or empty list gives no rows.
    """
    if steps < 1:
        raise ValueError("a scope has one step at least")
    parts = settle(classified(chunks(df, tokens, key, size), lexicon, key))
    started = parts.join(chunk_starts(parts, key, steps), [key, "chunk"], "left")
    reach = walk(F.col("classes"), F.coalesce("slots", _empty(steps)), steps)["reach"]
    zipped = F.arrays_zip(F.col("tokens").alias("token"), F.col("classes").alias("cls"), reach.alias("reach"))
    rows = started.select(key, "chunk", F.posexplode(zipped).alias("at", "z"))
    name = lambda code: F.get(F.array(F.lit(None), *[F.lit(C.CUE_NAMES[c]) for c in (1, 2, 3)]), code)
    named = rows.select(
        key,
        (F.col("chunk") * size + F.col("at")).alias("pos"),
        "z.token",
        name(F.col("z.cls") % 10).alias("cue"),
        F.get(F.array(*map(F.lit, _KIND_NAMES)), F.floor(F.col("z.cls") / 10).cast("int")).alias("kind"),
        name(F.col("z.reach")).alias("reach"),
    )
    return named.withColumn("tag", F.coalesce("cue", F.concat("reach", F.lit("_SCOPE")), F.lit("O")))


def with_tags(df: DataFrame, tokens: str, lexicon: C.Lexicon, out: str, key: str = "row_id") -> DataFrame:
    """Adds the list of tags: inside the row where the lexicon allows it, else by chunks and a join."""
    if lexicon.inline:
        return df.withColumn(out, C.concept_tags(F.col(tokens), lexicon))
    rows = tag_table_by_chunks(df, tokens, lexicon_table(df.sparkSession, lexicon), key, lexicon.steps)
    lists = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias(out))
    none = F.array().cast("array<string>")
    return df.join(lists, key, "left").withColumn(out, F.when(F.col(tokens).isNotNull(), F.coalesce(out, none)))


def classify_tokens(long: DataFrame, lexicon: DataFrame, negation_suffix: str = "n't") -> DataFrame:
    """Add ``cue`` and ``kind`` to ``(row_id, pos, token)`` rows by a lexicon join.

    One row per term carries all of its categories; the highest priority cue is
    emotion, then negation, then modality.
    """
    def flag(name):
        return F.max((F.col("category") == name).cast("int"))

    words = lexicon.filter(F.col("category") != "BOUNDARY").groupBy("term").agg(
        *[flag(n).alias(f"_{n}") for n in ("EMOTION", "NEGATION", "MODALITY", "SKIP")]
    )
    marks = lexicon.filter(F.col("category") == "BOUNDARY").select(
        F.col("term").alias("token"), F.lit(1).alias("_BOUNDARY")
    ).distinct()
    words = broadcast_if_small(words, MAX_BROADCAST_TERMS)
    marks = broadcast_if_small(marks, MAX_BROADCAST_TERMS)
    keyed = long.withColumn("term", C.token_key(F.col("token")))
    found = keyed.join(words, "term", "left").join(marks, "token", "left")
    negated = (F.col("_NEGATION") == 1) | F.col("term").endswith(negation_suffix)
    return found.select(
        *long.columns,
        F.when(F.col("_EMOTION") == 1, "EMOTION")
        .when(negated, "NEGATION")
        .when(F.col("_MODALITY") == 1, "MODALITY")
        .alias("cue"),
        F.when(F.col("_BOUNDARY") == 1, "boundary")
        .when((F.col("_SKIP") == 1) | F.col("token").rlike(PUNCT_TOKEN), "skip")
        .otherwise("content")
        .alias("kind"),
    )


def tag_tokens(classified: DataFrame, key: str = "row_id", steps: int = 3) -> DataFrame:
    """Add ``reach`` (type of the earliest cue in range) and ``tag``.

    Windows are per row of the corpus, so a partition is one text.
    """
    running = Window.partitionBy(key).orderBy("pos")
    counted = classified.withColumns(
        {
            "_segment": F.sum((F.col("kind") == "boundary").cast("int")).over(running),
            "_content": F.sum((F.col("kind") == "content").cast("int")).over(running),
        }
    )
    in_scope = (
        Window.partitionBy(key, "_segment").orderBy("_content").rangeBetween(-steps, -1)
    )
    # Position and type in one number: the smallest is the earliest cue.
    spreading = F.when(F.col("cue") == "NEGATION", F.col("pos") * 2).when(
        F.col("cue") == "MODALITY", F.col("pos") * 2 + 1
    )
    reached = counted.withColumn("_from", F.min(spreading).over(in_scope)).withColumn(
        "reach",
        F.when(
            (F.col("kind") == "content") & F.col("_from").isNotNull(),
            F.when(F.col("_from") % 2 == 0, "NEGATION").otherwise("MODALITY"),
        ),
    )
    tag = F.coalesce(F.col("cue"), F.concat("reach", F.lit("_SCOPE")), F.lit("O"))
    return reached.withColumn("tag", tag).drop("_segment", "_content", "_from")


def tag_table(
    df: DataFrame, tokens: str, lexicon: DataFrame, key: str = "row_id"
) -> DataFrame:
    """Explode, classify and tag in one go: ``(row_id, pos, token, cue, kind, reach, tag)``."""
    return tag_tokens(classify_tokens(explode_tokens(df, tokens, key), lexicon), key)
