"""Vocabularies: fit on the training split, then encode any split."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from claimwright import constants as K
from claimwright.functions.arrays import pad
from claimwright.operators.ranking import frequency_rank
from claimwright.session import settle

PAD_ID, UNKNOWN_ID = 0, 1
HOT_TOKENS = 100_000
RARE_SALTS = 16
#: Place of a token that the most frequent ones don't hold, and rows of a batch that are encoded at once.
_MISSING, _ROWS = -1, 1024


def explode_tokens(df: DataFrame, tokens: str, key: str = "row_id", extra: list[str] | None = None) -> DataFrame:
    """Long form ``(row_id, pos, token)``, positions from 0.

    The outer form with a filter after it does the same as the plain one, but
    keeps Spark from inferring a filter on the size of the list, which would
    compute a derived list again below the explode.
    """
    rows = df.select(key, *(extra or []), F.posexplode_outer(tokens).alias("pos", "token"))
    return rows.filter(F.col("pos").isNotNull())


def token_counts(df: DataFrame, tokens: str, key: str = "row_id") -> DataFrame:
    """Count and first position of every token.

    The position is one fixed-width decimal, row first, so the aggregate keeps
    its hash form and combines on the map side: a token that makes up a third
    of the corpus reaches its reducer as one row per map task.
    """
    place = F.col(key).cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col(
        "pos"
    ).cast("decimal(10,0)")
    return (
        explode_tokens(df, tokens, key)
        .groupBy("token")
        .agg(F.count("*").alias("cnt"), F.min(place).alias("first"))
    )


def fit_token_vocab(
    df: DataFrame, tokens: str, key: str = "row_id", min_count: int = K.VOCAB_MIN_COUNT
) -> DataFrame:
    """``(token, cnt, idx)``: frequent tokens first, ties by first occurrence, ids from 2."""
    # Stored, because the ranking looks at the counts three times.
    counts = settle(token_counts(df, tokens, key).filter(F.col("cnt") >= min_count))
    return frequency_rank(counts, "token").select(
        "token", "cnt", (F.col("rank") + 1).cast("int").alias("idx")
    )


def vocab_params(vocab: DataFrame, min_count: int = K.VOCAB_MIN_COUNT) -> DataFrame:
    """Key/value description; the size counts the two reserved ids."""
    size = vocab.agg((F.count("*") + 2).cast("string").alias("size"))
    facts = {
        "vocab_size": F.col("size"),
        "min_freq": F.lit(str(min_count)),
        "pad_token": F.lit("[PAD]"),
        "unk_token": F.lit("[UNK]"),
    }
    entries = F.array(
        *[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in facts.items()]
    )
    return size.select(F.inline(entries))


def _cuts(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _by_rows(one, *columns: pa.Array) -> pa.Array:
    """``one`` on some rows of a batch at a time; a batch without rows is one call."""
    return pa.concat_arrays([one(*(c.slice(k, _ROWS) for c in columns)) for k in range(0, max(len(columns[0]), 1), _ROWS)])


def _head_ids(tokens: Column, head: DataFrame) -> Column:
    """Ids by the tokens of ``head``, and places and spellings of the tokens it does not hold."""
    known = head.filter(F.col("token").isNotNull()).select("token", "idx").toArrow().combine_chunks()
    kind = dict(head.dtypes)["idx"]
    shared = SparkSession.getActiveSession().sparkContext.broadcast(known)

    @F.arrow_udf(f"struct<ids: array<{kind}>, misses: array<struct<pos: int, token: string>>>")
    def look_up(lists: pa.Array) -> pa.Array:
        words, numbers = (c.combine_chunks() for c in shared.value.columns)
        words = words.cast(pa.string())

        def some(part: pa.ListArray) -> pa.StructArray:
            sizes = pc.fill_null(part.value_lengths(), 0).to_numpy()
            flat = part.flatten()
            at = pc.index_in(flat, value_set=words)
            missing = pc.and_(at.is_null(), flat.is_valid())
            ids = pc.if_else(missing, pa.scalar(_MISSING, numbers.type), pc.take(numbers, at))
            holes = np.flatnonzero(missing.to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(len(part)), sizes)
            starts = np.cumsum(sizes) - sizes
            places = pa.array((holes - starts[row[holes]]).astype(np.int32))
            misses = pa.StructArray.from_arrays([places, flat.take(pa.array(holes))], ["pos", "token"])
            lists = [
                pa.ListArray.from_arrays(_cuts(sizes), ids, mask=part.is_null()),
                pa.ListArray.from_arrays(_cuts(np.bincount(row[holes], minlength=len(part))), misses),
            ]
            return pa.StructArray.from_arrays(lists, ["ids", "misses"])

        return _by_rows(some, lists)

    return look_up(tokens)


def _fill(lists: Column, found: Column, kind: str) -> Column:
    """A row's ids with those ``found`` later put in their places.

    Rows that share a key have several lists, whose ids are ordered by place, then by id.
    """

    @F.arrow_udf(f"array<{kind}>")
    def fill(lists: pa.Array, found: pa.Array) -> pa.Array:
        def ordered(own: list, more: list) -> list:
            pairs = [(p, x) for ids in own for p, x in enumerate(ids) if x != _MISSING] + [(m["pos"], m["idx"]) for m in more]
            return [x for _, x in sorted(pairs, key=lambda z: (z[0], z[1] is not None, z[1] or 0))]

        def some(own: pa.ListArray, more: pa.ListArray) -> pa.ListArray:
            of_type = own.type.value_type
            counts = own.value_lengths().to_numpy()
            if (counts > 1).any():
                return pa.array([ordered(*z) for z in zip(own.to_pylist(), more.to_pylist())], of_type)
            ids = own.flatten()
            sizes = np.zeros(len(own), np.int64)
            sizes[counts == 1] = ids.value_lengths().to_numpy()
            flat = ids.flatten()
            values = pc.fill_null(flat, 0).to_numpy().copy()
            place, idx = more.flatten().flatten()
            row = np.repeat(np.arange(len(own)), more.value_lengths().to_numpy())
            values[(np.cumsum(sizes) - sizes)[row] + place.to_numpy()] = idx.to_numpy()
            null = flat.is_null().to_numpy(zero_copy_only=False)
            return pa.ListArray.from_arrays(_cuts(sizes), pa.array(values, of_type.value_type, mask=null)).cast(of_type)

        return _by_rows(some, lists, found)

    return fill(lists, found)


def encode_tokens(
    df: DataFrame,
    vocab: DataFrame,
    tokens: str,
    length: int,
    key: str = "row_id",
    hot: int = HOT_TOKENS,
) -> DataFrame:
    """``(row_id, indices)``: ids of the first ``length`` tokens, unknown 1, padded with 0.

    Ids follow frequency, so the ``hot`` most frequent tokens are those with the
    smallest ids: that part has a fixed size and is sent to all tasks, which look
    it up inside the rows. Only tokens it does not hold become rows of their own, which
    are shuffled to meet the rest of the vocabulary, dealt out over salts, and then their
    row. An empty list and a null token keep their places.
    """
    cut = df.select(key, F.slice(tokens, 1, length).alias("_t"))
    head = vocab.filter(F.col("idx") <= hot + 1).select("token", "idx")
    tail = vocab.filter(F.col("idx") > hot + 1).select("token", "idx")
    kind = dict(vocab.dtypes)["idx"]
    # Stored once and narrow: tokens are kept only where the head does not know them.
    first = settle(cut.select(key, _head_ids(F.col("_t"), head).alias("_s")).select(key, "_s.ids", "_s.misses"))
    # A word frequent in these rows may be rare in the vocabulary or missing from it: salted.
    salt = F.pmod(F.xxhash64(key, "pos"), F.lit(RARE_SALTS)).cast("int")
    rest = first.select(key, F.inline("misses")).withColumn("_salt", salt)
    tail = tail.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(RARE_SALTS - 1))))
    rest = rest.join(tail, ["token", "_salt"], "left").withColumn("idx", F.coalesce("idx", F.lit(UNKNOWN_ID)))
    found = rest.select(key, F.lit(None).cast(f"array<{kind}>").alias("ids"), F.struct("pos", F.col("idx").cast(kind).alias("idx")).alias("_found"))
    own = first.select(key, "ids", F.lit(None).cast(f"struct<pos: int, idx: {kind}>").alias("_found"))
    # At most ``length`` items per row, so the lists stay small.
    listed = own.unionByName(found).groupBy(key).agg(F.collect_list("ids").alias("_lists"), F.collect_list("_found").alias("_more"))
    values = listed.select(key, _fill(F.col("_lists"), F.col("_more"), kind).alias("_ids"))
    return values.select(key, pad(F.col("_ids"), length, F.lit(PAD_ID)).alias("indices"))


def encode_inline(tokens, vocab: dict[str, int], length: int):
    """The same for a vocabulary of at most a few hundred words, as a Column."""
    if len(vocab) > 500:
        raise ValueError("use encode_tokens for a vocabulary of this size")
    ids = F.create_map(*[F.lit(x) for pair in vocab.items() for x in pair])
    found = F.transform(
        F.slice(tokens, 1, length),
        lambda t: F.coalesce(F.element_at(ids, t), F.lit(UNKNOWN_ID)),
    )
    return pad(found, length, F.lit(PAD_ID))


def top_values(df: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """The ``k`` most frequent values with ids from 1; 0 stays for unknown."""
    counts = df.groupBy(value).agg(F.count("*").alias("cnt"), F.min(order).alias("first"))
    best = counts.orderBy(F.desc("cnt"), "first").limit(k)  # top-k operator, k rows
    rank = F.row_number().over(Window.orderBy(F.desc("cnt"), "first"))
    return best.select(F.col(value).alias("value"), "cnt", rank.alias("idx"))
