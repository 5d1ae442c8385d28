"""Row-local work on arrays: truncation, padding, masks, alignment, attention."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from claimwright import constants as K


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    A lambda that mentions an outer expression computes it again for every
    element; a lambda variable is computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def head(tokens: Column, length: int | Column) -> Column:
    """The first ``length`` items."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.slice(tokens, F.lit(1), length)


def pad(values: Column, length: int | Column, fill: Column) -> Column:
    """Right-pad to ``length``."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(values, F.array_repeat(fill, F.greatest(length - F.size(values), F.lit(0))))


def _paired(tokens: Column, tags: Column) -> Column:
    n = F.least(F.size(tokens), F.size(tags))
    return F.arrays_zip(head(tokens, n).alias("t"), head(tags, n).alias("g"))


def keep_concept_tokens(tokens: Column, tags: Column) -> Column:
    """Tokens that carry a concept tag."""
    kept = F.filter(_paired(tokens, tags), lambda z: z["g"] != "O")
    return F.transform(kept, lambda z: z["t"])


def drop_concept_tokens(tokens: Column, tags: Column) -> Column:
    """Tokens without a concept tag."""
    kept = F.filter(_paired(tokens, tags), lambda z: z["g"] == "O")
    return F.transform(kept, lambda z: z["t"])


def channel_mask(tags: Column, channel: str) -> Column:
    """1 where a word's tag belongs to the channel."""
    return F.transform(tags, lambda t: t.isin(K.CHANNEL_TAGS[channel]).cast("int"))


def project_mask(word_mask: Column, word_index: Column) -> Column:
    """Word mask seen from sub-word slots; slots without a word give 0."""
    return let(
        word_mask,
        lambda m: F.transform(
            word_index,
            lambda w: F.when((w >= 0) & (w < F.size(m)), F.get(m, w)).otherwise(F.lit(0)),
        ),
    )


def mask_total(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda acc, x: acc + x.cast("int"))


def has_concept(mask: Column) -> Column:
    return F.exists(mask, lambda x: x > 0)


def subword_slots(
    words: Column, length: int = K.SUBWORD_LENGTH, piece_chars: int = 4
) -> Column:
    """Word index per sub-word slot: special slots and padding hold -1.

    The default splitter cuts a word into pieces of ``piece_chars`` characters, a
    stand-in for a trained sub-word model. Words are cut to ``length`` first: no
    word past that can reach a slot.
    """
    body = F.flatten(
        F.transform(
            head(words, length),
            lambda w, i: F.array_repeat(
                i.cast("int"), F.ceil(F.greatest(F.length(w), F.lit(1)) / piece_chars).cast("int")
            ),
        )
    )
    framed = F.concat(
        F.array(F.lit(-1)), head(body, length - 2), F.array(F.lit(-1))
    )
    return pad(framed, length, F.lit(-1))


def attention_slots(words: Column, length: int = K.SUBWORD_LENGTH, piece_chars: int = 4) -> Column:
    """1 for the slots that hold a piece or a special mark, 0 for padding."""
    pieces = F.aggregate(
        head(words, length),
        F.lit(0),
        lambda acc, w: acc
        + F.ceil(F.greatest(F.length(w), F.lit(1)) / piece_chars).cast("int"),
    )
    real = F.least(pieces, F.lit(length - 2)) + 2
    return pad(F.array_repeat(F.lit(1), real), length, F.lit(0))


def words_kept(word_index: Column) -> Column:
    """Distinct words that still own a slot."""
    return F.size(F.array_distinct(F.filter(word_index, lambda w: w >= 0)))


#: Rows of a batch that get their softmax at once, which bounds a task's memory.
_ROWS = 1024


def _softmax(scores: pa.ListArray, mask: pa.ListArray) -> pa.ListArray:
    """Softmax over the masked positions of some rows; the shorter of two lists ends in nulls."""
    null = pc.or_(scores.is_null(), mask.is_null())
    lengths = [pc.fill_null(pc.if_else(null, 0, x.value_lengths()), 0).to_numpy() for x in (scores, mask)]
    sizes = np.maximum(*lengths)
    starts = np.cumsum(sizes) - sizes
    gated, used = np.full(sizes.sum(), -np.inf), np.zeros(sizes.sum(), bool)

    def places(n: np.ndarray) -> np.ndarray:
        return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())

    marks, values = (x.filter(pc.invert(null)).flatten() for x in (mask, scores))
    used[places(lengths[1])] = pc.fill_null(pc.greater(marks, 0), False).to_numpy(zero_copy_only=False)
    at = places(lengths[0])[values.is_valid().to_numpy(zero_copy_only=False)]
    at, given = at[used[at]], values.drop_null().cast(pa.float64()).to_numpy(zero_copy_only=False)[used[at]]
    gated[at] = given
    used[:] = False
    used[at] = True
    heads = starts[sizes > 0]
    weights = np.zeros(len(gated))
    if len(gated):
        row = np.repeat(np.arange(len(heads)), sizes[sizes > 0])
        peak = np.maximum.reduceat(gated, heads)
        weights[used] = np.exp(gated[used] - peak[row[used]])
        total = np.maximum(np.add.reduceat(weights, heads), 1e-300)
        weights /= total[row]
    cuts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(cuts, pa.array(weights), mask=null)


def masked_softmax(scores: Column, mask: Column) -> Column:
    """Softmax over the masked positions of a row; all zeros when none is masked.

    Made by array operations on some rows at a time, inside their own tasks.
    """

    @F.arrow_udf("array<double>")
    def run(scores: pa.Array, mask: pa.Array) -> pa.Array:
        return pa.concat_arrays([_softmax(scores.slice(k, _ROWS), mask.slice(k, _ROWS)) for k in range(0, max(len(scores), 1), _ROWS)])

    return run(scores, mask)


def weighted_context(weights: Column, values: Column) -> Column:
    """Sum of ``values`` weighted by an attention row."""
    return F.aggregate(
        F.zip_with(weights, values, lambda w, v: w * v), F.lit(0.0), lambda acc, x: acc + x
    )


def gate(values: Column, flag: Column) -> Column:
    """Zero a feature block for rows whose flag is 0."""
    return F.transform(values, lambda x: x * flag)
