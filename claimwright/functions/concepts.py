"""Concept tags on token arrays: emotion, modality and negation, the last two with scope.

A token is a cue, or lies in the scope of the earliest cue that still reaches it,
or is ``O``. A cue's scope covers the next three content tokens; a clause boundary
ends it and skip words (determiners, adpositions, conjunctions, punctuation) do
not use up a step.

Tags come from array operations on the tokens of a thousand texts at a time, inside
the rows' own tasks, with no shuffle. Each distinct token is looked up once, and the work
is linear in the tokens.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from claimwright import constants as K

EMOTION, NEGATION, MODALITY = 1, 2, 3
CONTENT, BOUNDARY, SKIP = 0, 10, 20
CUE_NAMES = {EMOTION: "EMOTION", NEGATION: "NEGATION", MODALITY: "MODALITY"}
#: Texts of a batch that are tagged at once, which bounds a task's memory.
_ROWS = 1024


@dataclass(frozen=True)
class Lexicon:
    """Word lists of a tagger and the length of a scope.

    The functions here send the lists with the task and walk three steps; what is not
    ``inline`` is tagged by :mod:`claimwright.operators.concept_rows`.
    """

    emotion: tuple = field(default_factory=lambda: tuple(K.EMOTION_TERMS))
    modality: tuple = field(default_factory=lambda: tuple(K.MODALITY_TERMS))
    negation: tuple = field(default_factory=lambda: tuple(K.NEGATION_TERMS))
    skip: tuple = field(default_factory=lambda: tuple(K.SKIP_TERMS))
    boundaries: tuple = field(default_factory=lambda: tuple(K.SCOPE_BOUNDARIES))
    negation_suffix: str = "n't"
    steps: int = K.SCOPE_STEPS

    @property
    def inline(self) -> bool:
        """Whether the word lists fit into a task and three steps suffice."""
        return self.steps == 3 and sum(map(len, (self.emotion, self.modality, self.negation, self.skip))) <= 20_000


def token_key(token: Column) -> Column:
    return F.btrim(F.lower(token), F.lit("'`\""))


def _classifier(lexicon: Lexicon) -> Callable[[str | None], int]:
    """Cue type plus 0, 10 or 20 for content, boundary and skip tokens; a null token is content."""
    of_key = {t: CONTENT for t in (*lexicon.emotion, *lexicon.negation, *lexicon.modality)}
    of_key |= {t: SKIP for t in lexicon.skip}
    for terms, cue in ((lexicon.modality, MODALITY), (lexicon.negation, NEGATION), (lexicon.emotion, EMOTION)):
        of_key |= {t: of_key[t] - of_key[t] % 10 + cue for t in terms}
    boundaries, suffix = frozenset(lexicon.boundaries), lexicon.negation_suffix

    def class_of(token: str | None) -> int:
        if token is None:
            return CONTENT
        key = token.lower().strip("'`\"")
        known = of_key.get(key, 0)
        if known % 10 != EMOTION and key.endswith(suffix):
            known = known - known % 10 + NEGATION
        if token in boundaries:
            return known % 10 + BOUNDARY
        if known < SKIP and token and not token[0].isalpha() and not any(unicodedata.category(c)[0] in "LN" for c in token):
            known += SKIP
        return known

    return class_of


def _codes(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``cue * 10 + reach`` of the tokens of many texts, which begin at ``starts``.

    A group is a content token, a boundary or a text's start, and what follows up to the
    next one. Only a group's first cue counts, and a content token is reached by those of
    the three groups before its own, in the same segment, the earliest first.
    """
    cue, kind = classes % 10, classes - classes % 10
    new = kind == BOUNDARY
    new[starts] = True
    heads = np.flatnonzero(new | (kind == CONTENT))
    group = np.cumsum(new | (kind == CONTENT)) - 1
    segment = np.cumsum(new[heads])
    spreading = np.flatnonzero(cue >= NEGATION)
    at = group[spreading]
    first = spreading[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else spreading
    cue_of = np.zeros(len(heads), np.int32)
    cue_of[group[first]] = cue[first]
    reach = np.zeros(len(heads), np.int32)
    for back in (1, 2, 3):
        found = np.where(segment[back:] == segment[:-back], cue_of[:-back], 0)
        reach[back:] = np.where(found > 0, found, reach[back:])
    return cue * 10 + np.where(kind == CONTENT, reach[group], 0)


def _code_lists(lists: pa.ListArray, class_of: Callable[[str | None], int]) -> pa.ListArray:
    """The codes of a batch of token lists; a null list stays null."""
    sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy()
    words = lists.flatten().dictionary_encode(null_encoding="encode")
    of = np.array([class_of(w) for w in words.dictionary.to_pylist()], np.int32)
    ends = np.cumsum(sizes)
    classes = of[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int32)
    codes = _codes(classes, (ends - sizes)[sizes > 0])
    cuts = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(cuts, pa.array(codes, pa.int32()), mask=lists.is_null())


def concept_codes(tokens: Column, lexicon: Lexicon | None = None) -> Column:
    """``cue * 10 + reach`` per token, reach being the type of the cue that covers it."""
    lexicon = lexicon or Lexicon()
    if not lexicon.inline:
        raise ValueError("long word lists and other scopes go through operators.concept_rows")

    @F.arrow_udf("array<int>")
    def codes(batch: pa.Array) -> pa.Array:
        class_of = _classifier(lexicon)
        parts = [_code_lists(batch.slice(k, _ROWS), class_of) for k in range(0, len(batch), _ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return codes(tokens)


def _tag_name(cue: int, reach: int) -> str:
    if cue:
        return CUE_NAMES[cue]
    return f"{CUE_NAMES[reach]}_SCOPE" if reach in (NEGATION, MODALITY) else "O"


def tags_from_codes(codes: Column) -> Column:
    """A token's own cue, else the scope it lies in, else ``O``."""
    names = [_tag_name(code // 10, code % 10) for code in range(40)]
    table = F.split(F.lit(",".join(names)), ",")
    return F.transform(codes, lambda c: F.get(table, c))


def concept_tags(tokens: Column, lexicon: Lexicon | None = None) -> Column:
    return tags_from_codes(concept_codes(tokens, lexicon))


def concept_counters(codes: Column) -> dict[str, Column]:
    """Per-row counters; scope counts every token a cue reached, cues included."""

    def cues(kind):
        return F.size(F.filter(codes, lambda c: c.between(kind * 10, kind * 10 + 9)))

    def reached(kind):
        return F.size(F.filter(codes, lambda c: c % 10 == kind))

    return {
        "total_tokens": F.size(codes),
        "emotion_tokens": cues(EMOTION),
        "modality_cue_tokens": cues(MODALITY),
        "modality_scope_tokens": reached(MODALITY),
        "negation_cue_tokens": cues(NEGATION),
        "negation_scope_tokens": reached(NEGATION),
    }
