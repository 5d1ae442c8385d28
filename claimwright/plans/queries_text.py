"""Text functions over whole documents, conversations and pages."""

from pyspark.sql import functions as F

from claimwright.functions import concepts as C, text as T
from claimwright.operators import cleaning, concept_rows, vocab
from claimwright.plans import bindings as B
from claimwright.plans.registry import query

_HTML_SQL = "html"
for _block in (
    "(?is)<!--.*?-->",
    "(?is)<script[^>]*>.*?</script\\s*>",
    "(?is)<style[^>]*>.*?</style\\s*>",
    "(?is)<template[^>]*>.*?</template\\s*>",
    "(?s)</?[A-Za-z!][^>]*>",
):
    _HTML_SQL = f"regexp_replace({_HTML_SQL}, '{_block}', '', 'g')"
for _entity, _char in (
    ("&lt;?", "'<'"), ("&gt;?", "'>'"), ("&quot;?", "chr(34)"), ("&#39;?", "chr(39)"), ("&nbsp;?", "chr(160)"),
    ("&copy;?", "'©'"), ("&reg;?", "'®'"), ("&middot;?", "'·'"), ("&apos;", "chr(39)"), ("&ndash;", "'–'"),
    ("&mdash;", "'—'"), ("&hellip;", "'…'"), ("&amp;?", "'&'"),
):
    _HTML_SQL = f"regexp_replace({_HTML_SQL}, '{_entity}', {_char}, 'g')"


@query("html_strip", f"SELECT page_id, {_HTML_SQL} AS content FROM pages")
def html_strip(spark, sf):
    pages = B.table(spark, sf, "pages")
    return pages.select("page_id", T.strip_html(F.col("html")).alias("content"))


@query("html_parse", f"SELECT page_id, {_HTML_SQL} AS content FROM pages")
def html_parse(spark, sf):
    pages = B.table(spark, sf, "pages")
    return pages.select("page_id", T.html_to_text(F.col("html")).alias("content"))


@query("unicode_nfkc", "SELECT doc_id, nfc_normalize(text) AS normal FROM documents")
def unicode_nfkc(spark, sf):
    # Ligatures are put in, so the normal form has something to take out again.
    docs = B.table(spark, sf, "documents")
    marked = F.replace("text", F.lit("fi"), F.lit("ﬁ"))
    return docs.select("doc_id", T.nfkc(marked).alias("normal"))


_SHORT = (
    (" is ", "'s "), (" are ", "'re "), (" was ", "n't "), (" be ", "'ll "), (" as ", "'ve "),
    (" with ", " can't "), (" by ", " Won't "), (" this ", " it's "),
)
_SHORT_SQL = "text"
for _long, _cut in _SHORT:
    _SHORT_SQL = f"""replace({_SHORT_SQL}, '{_long}', '{_cut.replace("'", "''")}')"""
_FULL_SQL = _SHORT_SQL
for _head, _tail, _full in (
    ("c", "an''t", "annot"), ("w", "on''t", "ill not"), ("i", "t''s", "t is"),
    ("h", "e''s", "e is"), ("s", "he''s", "he is"), ("t", "hat''s", "hat is"),
    ("t", "here''s", "here is"), ("w", "hat''s", "hat is"), ("w", "ho''s", "ho is"),
):
    # Twice, since a match takes the character that the next one needs as its border.
    for _ in range(2):
        _FULL_SQL = (
            rf"regexp_replace({_FULL_SQL}, '(?i)(^|[^{B.WORD}])({_head}){_tail}([^{B.WORD}]|$)', '\1\2{_full}\3', 'g')"
        )
for _suffix, _full in (("n''t", " not"), ("''re", " are"), ("''ll", " will"), ("''ve", " have")):
    for _ in range(2):
        _FULL_SQL = rf"regexp_replace({_FULL_SQL}, '(?i)(\pL){_suffix}([^{B.WORD}]|$)', '\1{_full}\2', 'g')"


@query("contractions", f"SELECT doc_id, {_FULL_SQL} AS expanded FROM documents")
def contractions(spark, sf):
    text = F.col("text")
    for full, short in _SHORT:
        text = F.replace(text, F.lit(full), F.lit(short))
    return B.table(spark, sf, "documents").select(
        "doc_id", T.expand_contractions(text).alias("expanded")
    )


_URL_SQL = "url || ' ' || html"


@query(
    "url_mask",
    f"""SELECT page_id, {B.sql_mask_urls('(' + _URL_SQL + ')')} AS masked,
      CAST(len(regexp_extract_all({_URL_SQL}, 'http[^{B.SPACE}]+|www[^{B.SPACE}]+')) AS INT) AS urls
    FROM pages""",
)
def url_mask(spark, sf):
    text = F.concat_ws(" ", "url", "html")
    return B.table(spark, sf, "pages").select(
        "page_id", T.mask_urls(text).alias("masked"), T.url_count(text).alias("urls")
    )


@query(
    "emoji_names",
    """SELECT doc_id, CAST(len(text) - len(replace(text, '.', '')) AS INT) AS emojis,
      replace(text, '.', ' <EMO_grinning_face> ') AS named FROM documents""",
)
def emoji_names(spark, sf):
    # The corpus has no emoji: full stops stand in for them.
    text = F.replace("text", F.lit("."), F.lit("\U0001F600"))
    return B.table(spark, sf, "documents").select(
        "doc_id", T.emoji_count(text).alias("emojis"), T.name_emojis(text).alias("named")
    )


@query("allcaps_mark", f"SELECT doc_id, {B.sql_runs('text', B.CAPS_CASE)} AS marked FROM documents")
def allcaps_mark(spark, sf):
    return B.table(spark, sf, "documents").select(
        "doc_id", T.mark_allcaps(F.col("text")).alias("marked")
    )


@query("number_mask", f"SELECT doc_id, {B.sql_runs('text', B.NUMBER_CASE)} AS masked FROM documents")
def number_mask(spark, sf):
    return B.table(spark, sf, "documents").select(
        "doc_id", T.mask_numbers(F.col("text")).alias("masked")
    )


@query(
    "repeated_punctuation",
    f"""SELECT doc_id, {B.sql_collapse_marks('text')} AS marks,
      {B.sql_collapse_punct('text')} AS punct FROM documents""",
)
def repeated_punctuation(spark, sf):
    text = F.col("text")
    return B.table(spark, sf, "documents").select(
        "doc_id", T.collapse_marks(text).alias("marks"), T.collapse_punct(text).alias("punct")
    )


@query(
    "case_and_space",
    f"SELECT doc_id, {B.sql_collapse_space('lower(text)')} AS folded FROM documents",
)
def case_and_space(spark, sf):
    return B.table(spark, sf, "documents").select(
        "doc_id", T.collapse_space(F.lower("text")).alias("folded")
    )


_WORDS = ["the", "de", "und", "not"]


@query(
    "word_counts",
    f"""SELECT doc_id, CAST(len(c) AS INT) AS words, CAST(len([x for x in c if x IN {B.sql_list(_WORDS)}]) AS INT) AS hits
    FROM (SELECT doc_id, regexp_extract_all(text, '[^{B.SPACE}]+') AS c FROM documents)""",
)
def word_counts(spark, sf):
    text = F.col("text")
    return B.table(spark, sf, "documents").select(
        "doc_id",
        T.chunk_count(text).alias("words"),
        T.count_words(T.chunks(text), _WORDS).alias("hits"),
    )


@query(
    "verdict_prefix",
    f"WITH {B.HEADLINES_SQL} SELECT row_id, {B.sql_strip_prefix('statement')} AS stripped FROM headlines",
)
def verdict_prefix(spark, sf):
    return B.headlines(spark, sf).select(
        "row_id", T.strip_verdict_prefix(F.col("statement")).alias("stripped")
    )


@query("clean_shared_steps", f"SELECT doc_id, {B.sql_clean_basic('text')} AS clean FROM documents")
def clean_shared_steps(spark, sf):
    return B.table(spark, sf, "documents").select(
        "doc_id", T.clean_basic(F.col("text")).alias("clean")
    )


@query(
    "clean_political_profile",
    f"""SELECT doc_id, clean, {B.sql_collapse_punct(B.sql_collapse_space('clean'))} AS normal
    FROM (SELECT doc_id, {B.sql_clean_basic('text')} AS clean FROM documents)""",
)
def clean_political_profile(spark, sf):
    # Markup, emoji and contractions do not occur here, so the shared steps say it all.
    docs = B.table(spark, sf, "documents").select("doc_id", "text")
    clean = cleaning.clean_political(docs, "text", "clean")
    return cleaning.normalize_political(clean, "clean", "normal").drop("text")


@query(
    "clean_health_profile",
    f"""WITH {B.HEADLINES_SQL} SELECT row_id, clean, {B.sql_collapse_space('clean')} AS normal
    FROM (SELECT row_id, {B.sql_trim_space(B.sql_clean_basic(B.sql_strip_prefix('statement')))} AS clean FROM headlines)""",
)
def clean_health_profile(spark, sf):
    clean = cleaning.clean_health(B.headlines(spark, sf), out="clean")
    return cleaning.normalize_health(clean, "clean", "normal").select("row_id", "clean", "normal")


@query(
    "tokenize_words",
    f"WITH {B.TOKENS_SQL} SELECT row_id, CAST(len(tokens) AS INT) AS n, array_to_string(tokens, ' ') AS joined FROM docs",
)
def tokenize_words(spark, sf):
    return B.tokens(spark, sf).select(
        "row_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("joined")
    )


@query(
    "reasoning_units",
    rf"""WITH {B.TOKENS_SQL} SELECT row_id, CAST(len(tokens) AS INT) AS total_tokens,
      CAST(len([t for t in tokens if regexp_full_match(t, '[^\pL\pN]+') AND t[1] <> '<' AND NOT starts_with(t, '__')]) AS INT) AS punctuation_tokens,
      CAST(len([t for t in tokens if lower(t) IN ('not', 'no', 'never', 'none', 'n''t')]) AS INT) AS negation_tokens,
      CAST(len([t for t in tokens if regexp_full_match(t, '<[^>]+>')]) AS INT) AS special_tokens
    FROM docs""",
)
def reasoning_units(spark, sf):
    counters = T.token_counters(F.col("tokens"))
    return B.tokens(spark, sf).select("row_id", *[c.alias(n) for n, c in counters.items()])


@query("token_rows", f"WITH {B.TOKENS_SQL} SELECT row_id, unnest(range(len(tokens)))::INT AS pos, unnest(tokens) AS token FROM docs")
def token_rows(spark, sf):
    return vocab.explode_tokens(B.tokens(spark, sf), "tokens")


@query(
    "list_literal",
    f"""WITH {B.TOKENS_SQL} SELECT row_id, CAST(len(tokens) AS INT) AS n, array_to_string(tokens, ' ') AS joined FROM docs""",
)
def list_literal(spark, sf):
    # Token lists written the way Python prints them, then read back.
    quoted = F.transform(
        "tokens",
        lambda t: F.when(t.contains("'"), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("'"))
        ),
    )
    cell = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    rows = B.tokens(spark, sf).select("row_id", T.parse_list_literal(cell).alias("tokens"))
    return rows.select(
        "row_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("joined")
    )


@query(
    "concept_tags",
    f"""WITH {B.TOKENS_SQL}, {B.sql_tagged('docs')}
    SELECT row_id, string_agg(tag, ' ' ORDER BY pos) AS tags,
      CAST(count(*) FILTER (cue = 'EMOTION') AS INT) AS emotion_tokens,
      CAST(count(*) FILTER (cue = 'MODALITY') AS INT) AS modality_cue_tokens,
      CAST(count(*) FILTER (reach = 'MODALITY') AS INT) AS modality_scope_tokens,
      CAST(count(*) FILTER (cue = 'NEGATION') AS INT) AS negation_cue_tokens,
      CAST(count(*) FILTER (reach = 'NEGATION') AS INT) AS negation_scope_tokens
    FROM tagged GROUP BY row_id""",
)
def concept_tags(spark, sf):
    codes = B.tokens(spark, sf).select(
        "row_id", C.concept_codes(F.col("tokens"), B.TEST_LEXICON).alias("codes")
    )
    counters = C.concept_counters(F.col("codes"))
    counters.pop("total_tokens")
    return codes.select(
        "row_id",
        F.array_join(C.tags_from_codes(F.col("codes")), " ").alias("tags"),
        *[c.alias(n) for n, c in counters.items()],
    )


@query(
    "concept_tags_by_join",
    f"""WITH {B.TOKENS_SQL}, {B.sql_tagged('docs')}
    SELECT row_id, CAST(pos AS INT) AS pos, token, cue, reach, tag FROM tagged""",
)
def concept_tags_by_join(spark, sf):
    lexicon = concept_rows.lexicon_table(spark, B.TEST_LEXICON)
    return concept_rows.tag_table(B.tokens(spark, sf), "tokens", lexicon).select(
        "row_id", "pos", "token", "cue", "reach", "tag"
    )
