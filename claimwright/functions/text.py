"""Text cleaning, normalising and tokenising as Column expressions.

Character classes are spelled out instead of using the regex shorthands, because
the shorthands mean different things in different engines and Java versions. A
word character is a letter, a number or the underscore; white space is the
Unicode set.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from claimwright import constants as K

SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"

# Patterns of the cleaning steps
# A look-ahead comes first where it is the cheaper one to fail.
URL = rf"(?=[hw])(?:http[^{SPACE}]+|www[^{SPACE}]+)"
ALLCAPS = rf"(?=[A-Z]{{2}})(?<![{WORD}])([A-Z]{{2,}})(?![{WORD}])"
NUMBER = rf"(?=\p{{Nd}})(?<![{WORD}])\p{{Nd}}+(?![{WORD}])"
REPEAT_MARKS = r"([!?]){2,}"
REPEAT_PUNCT = r"([.,!?]){2,}"
# Words come first and never backtrack: no other kind begins with their characters.
TOKEN = rf"(?=[^\x20])(?:(?:[a-z]++|[{WORD}]++)++(?:'\p{{L}}++)*+|<[^<>{SPACE}]+>|[^{SPACE}{WORD}])"
CHUNK = rf"[^{SPACE}]+"
_ROWS = 256
PUNCT_TOKEN = r"^[^\p{L}\p{N}]+$"
# Characters that no normal form changes, neither alone nor beside each other.
STABLE = (
    r"\x00-\x7f\x{a1}-\x{a7}\x{a9}\x{ab}-\x{ae}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}\x{bf}-\x{131}"
    r"\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}"
)
UNSTABLE = rf"(?=[^\x00-\x7f])[^{STABLE}]"
EMOJI = (
    r"[\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}"
    r"\x{2600}-\x{26FF}\x{2700}-\x{27BF}]"
)
# Fails fast on texts that can hold no emoji.
HIGH = r"[^\x00-\x{25FF}]"


# -- counting ---------------------------------------------------------------


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def chunks(text: Column) -> Column:
    """White-space separated pieces."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunk_count(text: Column) -> Column:
    return count_matches(text, CHUNK)


def count_words(tokens: Column, words: list[str], fold_case: bool = False) -> Column:
    """How many tokens are in ``words``."""
    key = F.lower if fold_case else (lambda t: t)
    return F.size(F.filter(tokens, lambda t: key(t).isin(words)))


# -- single steps -----------------------------------------------------------


def strip_html(text: Column) -> Column:
    """Tags and comments out, script and style bodies out, common entities decoded.

    Stays in the JVM. Numeric and rare entities are left to :func:`html_to_text`.
    """
    for block in (
        r"(?is)<!--.*?-->",
        r"(?is)<script[^>]*>.*?</script\s*>",
        r"(?is)<style[^>]*>.*?</style\s*>",
        r"(?is)<template[^>]*>.*?</template\s*>",
        r"(?s)</?[A-Za-z!][^>]*>",
    ):
        text = F.regexp_replace(text, block, "")
    # The first group may lack its semicolon. The ampersand comes last, or it would
    # make new entities.
    for entity, char in (
        ("&lt;?", "<"),
        ("&gt;?", ">"),
        ("&quot;?", '"'),
        ("&#39;?", "'"),
        ("&nbsp;?", "\u00a0"),
        ("&copy;?", "©"),
        ("&reg;?", "®"),
        ("&middot;?", "·"),
        ("&apos;", "'"),
        ("&ndash;", "–"),
        ("&mdash;", "—"),
        ("&hellip;", "…"),
        ("&amp;?", "&"),
    ):
        text = F.regexp_replace(text, entity, char)
    return text


def _by_text(text: Column, load: Callable[[], Callable[[str], str]]) -> Column:
    """``load()`` on each text in Python, some of a batch's texts at a time."""

    @F.arrow_udf(StringType())
    def run(batch: pa.Array) -> pa.Array:
        one = load()
        parts = [
            pa.array([None if v is None else one(v) for v in batch.slice(k, _ROWS).to_pylist()], pa.string())
            for k in range(0, len(batch), _ROWS)
        ]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run(text)


def html_to_text(text: Column) -> Column:
    """Visible text by a real HTML parser; only rows that can hold markup pay for it."""

    def load():
        from html.parser import HTMLParser

        class Visible(HTMLParser):
            hidden_tags = ("script", "style", "template")

            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.parts, self.hidden = [], 0

            def handle_starttag(self, tag, attrs):
                self.hidden += tag in self.hidden_tags

            def handle_endtag(self, tag):
                if tag in self.hidden_tags and self.hidden:
                    self.hidden -= 1

            def handle_data(self, data):
                if not self.hidden:
                    self.parts.append(data)

        def one(value):
            parser = Visible()
            parser.feed(value)
            parser.close()
            return "".join(parser.parts)

        return one

    marked = F.when(text.contains("<") | text.contains("&"), text)
    return F.coalesce(_by_text(marked, load), text)


def nfkc(text: Column) -> Column:
    """Unicode compatibility normal form; rows of stable characters skip the Python worker's work."""

    def load():
        import unicodedata

        return lambda v: unicodedata.normalize("NFKC", v)

    return F.coalesce(_by_text(F.when(text.rlike(UNSTABLE), text), load), text)


def expand_contractions(
    text: Column,
    words: dict[str, str] | None = None,
    suffixes: dict[str, str] | None = None,
) -> Column:
    """Irregular forms first, then regular suffixes; curly apostrophes count too."""
    words = K.CONTRACTION_WORDS if words is None else words
    suffixes = K.CONTRACTION_SUFFIXES if suffixes is None else suffixes
    out = F.regexp_replace(text, rf"(?<=\p{{L}})\x{{2019}}(?=\p{{L}})", "'")
    for short, full in words.items():
        head, tail = re.escape(short[0]), re.escape(short[1:])
        out = F.regexp_replace(
            out, rf"(?i)(?={head})(?<![{WORD}])({head}){tail}(?![{WORD}])", "$1" + full[1:]
        )
    for short, full in suffixes.items():
        out = F.regexp_replace(out, rf"(?i)(?={re.escape(short[:2])})(?<=\p{{L}}){re.escape(short)}(?![{WORD}])", full)
    return F.when(text.rlike(r"['\x{2019}]"), out).otherwise(text)


def url_count(text: Column) -> Column:
    return count_matches(text, URL)


def mask_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "<URL>")


def emoji_count(text: Column) -> Column:
    return count_matches(text, EMOJI)


def name_emojis(text: Column) -> Column:
    """Every emoji becomes `` <EMO_name> `` with its Unicode character name."""
    pattern = EMOJI

    def load():
        import re
        import unicodedata

        # \x{..} is the JVM's notation; Python wants \U........
        find = re.compile(
            re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\U" + m.group(1).zfill(8), pattern)
        )

        def name(match):
            label = unicodedata.name(match.group(0), "symbol").lower().replace(" ", "_")
            return f" <EMO_{label}> "

        return lambda v: find.sub(name, v)

    marked = F.when(text.rlike(HIGH) & text.rlike(EMOJI), text)
    return F.coalesce(_by_text(marked, load), text)


def mark_allcaps(text: Column, mark_placeholders: bool = True) -> Column:
    """Prefix words in capitals with a marker.

    Placeholders such as ``<URL>`` are marked as well, giving ``<<ALLCAPS> URL>``;
    pass ``mark_placeholders=False`` to leave them alone.
    """
    pattern = ALLCAPS if mark_placeholders else r"(?<!<)" + ALLCAPS + r"(?!>)"
    return F.regexp_replace(text, pattern, "<ALLCAPS> $1")


def mask_numbers(text: Column) -> Column:
    return F.regexp_replace(text, NUMBER, "<NUM>")


def collapse_marks(text: Column) -> Column:
    """Runs of ``!`` and ``?`` shrink to their last character."""
    return F.regexp_replace(text, REPEAT_MARKS, "$1")


def collapse_punct(text: Column) -> Column:
    """Runs of ``. , ! ?`` shrink to their last character."""
    return F.regexp_replace(text, REPEAT_PUNCT, "$1")


def collapse_space(text: Column) -> Column:
    # A blank before a printable character is what it shall be already.
    one = F.regexp_replace(text, rf"(?=[^!-~])(?!\x20[!-~])[{SPACE}]+", " ")
    return F.trim(one)


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def strip_verdict_prefix(text: Column, prefixes: list[str] | None = None) -> Column:
    """Drop leading verdict words such as ``FAKE:``; two passes for double prefixes.

    A hyphen is a separator too, so ``Real-time data`` becomes ``time data``.
    """
    for _ in range(2):
        for prefix in prefixes or K.VERDICT_PREFIXES:
            word = prefix.replace(r"\s", SPACE)
            text = F.regexp_replace(
                text, rf"(?i)^[{SPACE}]*{word}[{SPACE}]*[:!\-][{SPACE}]*", ""
            )
    return text


# -- steps every cleaning profile shares --------------------------------------


def clean_basic(text: Column) -> Column:
    """The JVM-only part every profile shares: URL, caps, numbers, marks, case."""
    return F.lower(collapse_marks(mask_numbers(mark_allcaps(mask_urls(text)))))


# -- tokens -----------------------------------------------------------------


def tokenize(text: Column) -> Column:
    """Words, single punctuation marks and ``<...>`` markers, each one token.

    ``n't`` is split off its verb first, so a negation is a token of its own.
    """
    split = F.regexp_replace(text, rf"(?=[nN]')(?<=\p{{L}})([nN]'[tT])(?![{WORD}])", " $1")
    return F.regexp_extract_all(split, F.lit(TOKEN), F.lit(0))


def is_punct_token(token: Column) -> Column:
    return token.rlike(PUNCT_TOKEN) & ~token.startswith("<") & ~token.startswith("__")


def is_special_token(token: Column) -> Column:
    return token.rlike(r"^<[^>]+>$")


def token_counters(tokens: Column) -> dict[str, Column]:
    """Per-row counters of a token list; sum them for a corpus summary."""
    return {
        "total_tokens": F.size(tokens),
        "punctuation_tokens": F.size(F.filter(tokens, is_punct_token)),
        "negation_tokens": count_words(tokens, K.NEGATION_WORDS, fold_case=True),
        "special_tokens": F.size(F.filter(tokens, is_special_token)),
    }


def parse_list_literal(cell: Column) -> Column:
    """Read a list of strings written as a Python literal, e.g. ``['a', "b's"]``.

    Each quoted item is matched on its own, so either quote character may hold
    the other one; ``\\'``, ``\\"`` and ``\\\\`` are unescaped. Anything that is
    not a list gives an empty array.
    """
    item = r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\""
    quoted = F.regexp_extract_all(cell, F.lit(item), F.lit(0))

    def unescape(q: Column) -> Column:
        body = F.substring(q, F.lit(2), F.length(q) - 2)
        body = F.regexp_replace(body, r"\\n", "\n")
        return F.regexp_replace(body, r"\\(.)", "$1")

    return F.when(
        cell.rlike(r"(?s)^\s*\[.*\]\s*$"), F.transform(quoted, unescape)
    ).otherwise(F.array().cast("array<string>"))
