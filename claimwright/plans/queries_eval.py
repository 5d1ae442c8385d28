"""Metrics, losses, run records, rationales and curated cards over scored rows."""

from pyspark.sql import functions as F

from claimwright import constants as K
from claimwright.functions import arrays as A, concepts as C, labels as L, maths as M
from claimwright.operators import curate, metrics, rationale, runs
from claimwright.plans import bindings as B
from claimwright.plans.registry import query
from claimwright.session import settle

# -- predictions and metrics ---------------------------------------------------------


@query(
    "softmax_and_class",
    f"WITH {B.SCORED_SQL} SELECT row_id, pred, round(conf, 6) AS conf, has_meta FROM scored",
)
def softmax_and_class(spark, sf):
    return B.scored(spark, sf).select("row_id", "pred", F.round("conf", 6).alias("conf"), "has_meta")


@query("accuracy", f"WITH {B.SCORED_SQL} SELECT round(avg(CAST(pred = label AS INT)), 6) AS accuracy FROM scored")
def accuracy(spark, sf):
    return metrics.accuracy(B.scored(spark, sf))


_CLASSES_SQL = f"""{B.SCORED_SQL},
per_class AS (
  SELECT c AS cls, count(*) FILTER (label = c) AS support, count(*) FILTER (pred = c) AS predicted, count(*) FILTER (label = c AND pred = c) AS tp
  FROM scored, (SELECT DISTINCT label AS c FROM scored UNION SELECT DISTINCT pred FROM scored) GROUP BY c),
ratios AS (
  SELECT cls, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
    CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) ELSE 0 END AS f1 FROM per_class)"""


@query(
    "classification_report",
    f"""WITH {_CLASSES_SQL}, acc AS (SELECT avg(CAST(pred = label AS INT)) AS a, count(*) AS n FROM scored),
    lines AS (
      SELECT CASE cls WHEN 0 THEN 'fake' ELSE 'real' END AS row, precision, recall, f1, support FROM ratios
      UNION ALL SELECT 'accuracy', a, a, a, n FROM acc
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM ratios
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM ratios)
    SELECT row, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, CAST(support AS BIGINT) AS support FROM lines""",
)
def classification_report(spark, sf):
    return metrics.classification_report(B.scored(spark, sf))


@query("macro_f1", f"WITH {_CLASSES_SQL} SELECT round(avg(f1), 6) AS macro_f1 FROM ratios")
def macro_f1(spark, sf):
    return metrics.macro_f1(B.scored(spark, sf))


@query(
    "domain_report",
    f"""WITH {B.SCORED_SQL}, d AS (
      SELECT CASE has_meta WHEN 1 THEN 'political' ELSE 'health' END AS domain, label, pred FROM scored
      UNION ALL SELECT 'overall', label, pred FROM scored),
    per_class AS (SELECT domain, c, count(*) FILTER (label = c) AS support, count(*) FILTER (pred = c) AS predicted, count(*) FILTER (label = c AND pred = c) AS tp
      FROM d, (VALUES (0), (1)) AS v(c) GROUP BY ALL)
    SELECT domain, CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(2 * tp / (predicted + support)), 6) AS macro_f1
    FROM per_class WHERE predicted + support > 0 GROUP BY domain""",
)
def domain_report(spark, sf):
    return metrics.domain_report(B.scored(spark, sf))


@query("channel_means", f"WITH {B.SCORED_SQL} SELECT round(avg(em), 6) AS em_mean, round(avg(mo), 6) AS mo_mean, round(avg(ne), 6) AS ne_mean FROM scored")
def channel_means(spark, sf):
    return metrics.channel_means(B.scored(spark, sf))


def _ce(a: str, b: str, label: str = "label") -> str:
    return f"(greatest({a}, {b}) + ln(1 + exp(-abs({a} - {b}))) - CASE {label} WHEN 1 THEN {b} ELSE {a} END)"


_WEIGHTED_SQL = f"""{B.SCORED_SQL},
w AS (SELECT label, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS class_weight FROM scored GROUP BY label),
rows_w AS (SELECT s.*, w.class_weight, em * 2 - 1 AS em_logit0, 1 - mo AS em_logit1, mo - ne AS mo_logit0, em AS mo_logit1,
    ne AS ne_logit0, ne * em AS ne_logit1, CAST(em > 0.3 AS INT) AS em_present, CAST(mo > 0.5 AS INT) AS mo_present, CAST(ne > 0.9 AS INT) AS ne_present
  FROM scored s JOIN w ON s.label = w.label)"""


@query(
    "weighted_losses",
    f"""WITH {_WEIGHTED_SQL}, c AS (SELECT class_weight AS w, {_ce('logit0', 'logit1')} AS ce, {_ce('logit0', 'logit1', '1 - label')} AS other FROM rows_w)
    SELECT round(avg(w * (0.95 * ce + 0.05 * other)), 6) AS smoothed_ce, round(avg(power(1 - exp(-w * ce), 2) * w * ce), 6) AS focal FROM c""",
)
def weighted_losses(spark, sf):
    return metrics.weighted_losses(B.scored(spark, sf))


def _gated(c: str) -> str:
    keep = f"FILTER ({c}_present = 1)"
    return f"coalesce(sum(class_weight * {_ce(f'{c}_logit0', f'{c}_logit1')}) {keep} / sum(class_weight) {keep}, 0)"


@query(
    "training_objective",
    f"""WITH {_WEIGHTED_SQL}, o AS (SELECT has_meta, avg(class_weight * (0.95 * {_ce('logit0', 'logit1')} + 0.05 * {_ce('logit0', 'logit1', '1 - label')})) AS main_loss,
        {' + '.join(_gated(c) for c in ('em', 'mo', 'ne'))} AS aux_loss,
        {' + '.join(f'coalesce(greatest(0.3 - avg({c}) FILTER ({c}_present = 1), 0), 0)' for c in ('em', 'mo', 'ne'))} AS cov_loss
      FROM rows_w GROUP BY has_meta)
    SELECT has_meta, round(main_loss, 6) AS main_loss, round(aux_loss, 6) AS aux_loss, round(cov_loss, 6) AS cov_loss,
      round(main_loss + 0.3 * aux_loss + 0.05 * cov_loss, 6) AS train_loss FROM o""",
)
def training_objective(spark, sf):
    em, mo, ne = F.col("em"), F.col("mo"), F.col("ne")
    rows = metrics.with_class_weight(B.scored(spark, sf)).withColumns(
        {
            "em_logit0": em * 2 - 1, "em_logit1": 1 - mo,
            "mo_logit0": mo - ne, "mo_logit1": em,
            "ne_logit0": ne, "ne_logit1": ne * em,
            "em_present": (em > 0.3).cast("int"),
            "mo_present": (mo > 0.5).cast("int"),
            "ne_present": (ne > 0.9).cast("int"),
        }
    )
    return metrics.objective(rows, by=["has_meta"])


# -- runs ------------------------------------------------------------------------------


@query(
    "seed_summary",
    f"WITH {B.RESULTS_SQL} SELECT setting, round(avg(test_macro_f1), 8) AS mean, round(stddev_samp(test_macro_f1), 8) AS std, count(*) AS n FROM results GROUP BY setting",
)
def seed_summary(spark, sf):
    return runs.seed_summary(B.results(spark, sf), by="setting")


_SETTINGS = ["frozen_single", "frozen_merged", "tuned_single", "tuned_merged"]


@query(
    "ablation_matrix",
    f"WITH {B.RESULTS_SQL} SELECT phase, {', '.join(f'round(avg(test_macro_f1) FILTER (setting = {chr(39)}{x}{chr(39)}), 8) AS {x}' for x in _SETTINGS)} FROM results GROUP BY phase",
)
def ablation_matrix(spark, sf):
    return runs.ablation_matrix(B.results(spark, sf), "phase", "setting", _SETTINGS)


@query(
    "best_epoch",
    f"""WITH {B.EPOCHS_SQL} SELECT tag, seed, epoch AS best_epoch, val_macro_f1 AS best_score FROM epochs
    QUALIFY row_number() OVER (PARTITION BY tag, seed ORDER BY val_macro_f1 DESC, epoch) = 1""",
)
def best_epoch(spark, sf):
    return runs.best_epoch(B.epochs(spark, sf))


@query(
    "early_stop",
    f"""WITH RECURSIVE {B.EPOCHS_SQL},
    n AS (SELECT *, row_number() OVER (PARTITION BY tag, seed ORDER BY epoch) AS i FROM epochs),
    run AS (
      SELECT tag, seed, i, epoch, val_macro_f1 AS best, epoch AS best_epoch, 0 AS wait FROM n WHERE i = 1
      UNION ALL
      SELECT n.tag, n.seed, n.i, n.epoch, greatest(run.best, n.val_macro_f1),
        CASE WHEN n.val_macro_f1 > run.best THEN n.epoch ELSE run.best_epoch END,
        CASE WHEN n.val_macro_f1 > run.best THEN 0 ELSE run.wait + 1 END
      FROM run JOIN n ON n.tag = run.tag AND n.seed = run.seed AND n.i = run.i + 1 WHERE run.wait < 5)
    SELECT tag, seed, best_epoch, epoch AS stop_epoch, wait >= 5 AS stopped_early FROM run
    QUALIFY row_number() OVER (PARTITION BY tag, seed ORDER BY i DESC) = 1""",
)
def early_stop(spark, sf):
    return runs.early_stop(B.epochs(spark, sf))


@query(
    "latest_log_entry",
    "SELECT event_type AS step, max(ts) AS ts, arg_max(props, ts) AS metrics FROM events GROUP BY event_type",
)
def latest_log_entry(spark, sf):
    log = B.table(spark, sf, "events").select(
        F.col("event_type").alias("step"), "ts", F.col("props").alias("metrics")
    )
    return runs.latest_per_step(log)


# -- rationales --------------------------------------------------------------------------

_BANDS = "CASE WHEN {s} < 0.1 THEN 'negligible' WHEN {s} < 0.2 THEN 'low' WHEN {s} < 0.4 THEN 'moderate' WHEN {s} < 0.65 THEN 'high' ELSE 'very high' END"
_LEVEL = "CASE WHEN {s} >= 0.55 THEN 'HIGH' WHEN {s} >= 0.3 THEN 'medium' ELSE 'low' END"


@query(
    "score_bands",
    f"WITH {B.SCORED_SQL} SELECT row_id, {_LEVEL.format(s='em')} AS level, {_BANDS.format(s='em')} AS band FROM scored",
)
def score_bands(spark, sf):
    em = F.col("em")
    return B.scored(spark, sf).select(
        "row_id", L.score_level(em).alias("level"), L.score_band(em).alias("band")
    )


def _line(number: int, channel: str, s: str) -> str:
    text = K.CHANNEL_TEXT[channel]
    lead = f"Step {number} [{channel.capitalize()}]:".ljust(20)
    return (
        f"printf('{lead}score %.2f → %-6s  — ', {s}, {_LEVEL.format(s=s)}) || CASE {_LEVEL.format(s=s)} "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.items())
        + " END"
    )


_PAIRS = (("emotion", "em"), ("modality", "mo"), ("negation", "ne"))
_LINES = [_line(i, c, s) for i, (c, s) in enumerate(_PAIRS, 1)]
_VERDICT = "'Verdict:     ' || CASE pred WHEN 0 THEN 'FAKE' ELSE 'REAL' END, printf('Confidence:  %.1f%%', conf * 100)"
_DRIVERS = "concat_ws(' and ', CASE WHEN em >= 0.55 THEN 'emotional language' END, CASE WHEN ne >= 0.55 THEN 'negation patterns' END, CASE WHEN mo >= 0.55 THEN 'hedging language' END)"
_SUMMARY = (
    "CASE WHEN drivers <> '' AND pred = 0 THEN 'This claim contains ' || drivers || ', which are common indicators of misleading content.' "
    "WHEN drivers <> '' THEN 'Despite some ' || drivers || ', the overall pattern is consistent with credible content.' "
    f"WHEN pred = 0 THEN '{K.SUMMARY_TEXT['none_fake']}' ELSE '{K.SUMMARY_TEXT['none_real']}' END"
)


@query(
    "rationale_text",
    f"""WITH {B.SCORED_SQL} SELECT row_id, concat_ws(chr(10), {', '.join(_LINES)}, repeat('─', 45), {_VERDICT}, repeat('─', 45), 'Reasoning: ' || {_SUMMARY}) AS rationale
    FROM (SELECT *, {_DRIVERS} AS drivers FROM scored)""",
)
def rationale_text(spark, sf):
    args = [F.col(c) for c in ("em", "mo", "ne", "logit0", "logit1")]
    return B.scored(spark, sf).select("row_id", rationale.rationale_text(*args).alias("rationale"))


@query(
    "rationale_samples",
    f"""WITH {B.SCORED_SQL}, r AS (SELECT row_id, concat_ws(chr(10), {', '.join(_LINES)}, repeat('─', 45), {_VERDICT}, repeat('─', 45), 'Reasoning: ' || {_SUMMARY}) AS t
      FROM (SELECT *, {_DRIVERS} AS drivers FROM scored) ORDER BY row_id LIMIT 10)
    SELECT CAST(row_number() OVER (ORDER BY row_id) AS INT) AS example,
      '--- example ' || row_number() OVER (ORDER BY row_id) || ' ---' || chr(10) || t || chr(10) AS block FROM r""",
)
def rationale_samples(spark, sf):
    args = [F.col(c) for c in ("em", "mo", "ne", "logit0", "logit1")]
    return rationale.sample_rationales(B.scored(spark, sf), rationale.rationale_text(*args))


_PHRASES = "[x.p for x in list_sort([z for z in [{'s': -em, 'o': 0, 'p': 'affective framing'}, {'s': -mo, 'o': 1, 'p': 'modal/hedging language'}, {'s': -ne, 'o': 2, 'p': 'negation cues'}] if z.s <= -0.2])]"
_HUMAN = (
    f"printf('Verdict driven %s. → predicted %s (confidence %.2f).', CASE len(names) WHEN 0 THEN '{K.SUMMARY_NONE}' "
    "WHEN 1 THEN 'primarily by the ' || names[1] || ' the model attended to' "
    "ELSE 'by ' || array_to_string(names[:-2], ', ') || ' and ' || names[-1] END, CASE pred WHEN 0 THEN 'FAKE' ELSE 'REAL' END, conf)"
)


@query(
    "human_summary",
    f"WITH {B.SCORED_SQL} SELECT row_id, {_HUMAN} AS summary FROM (SELECT *, {_PHRASES} AS names FROM scored)",
)
def human_summary(spark, sf):
    args = [F.col(c) for c in ("em", "mo", "ne", "pred", "conf")]
    return B.scored(spark, sf).select("row_id", curate.human_summary(*args).alias("summary"))


# -- attention ------------------------------------------------------------------------------


def attention(spark, sf):
    """Words, tags, and for each channel a mask and one attention row of each whole document."""
    rows = B.tokens(spark, sf).select("row_id", F.col("tokens").alias("words"))
    rows = rows.withColumn("tags", C.concept_tags(F.col("words"), B.TEST_LEXICON))
    rows = rows.withColumn("strength", F.transform("words", lambda w, i: F.length(w) / 4 + i / 1000))
    rows = rows.withColumns({f"in_{short}": A.channel_mask(F.col("tags"), channel) for channel, short in _PAIRS})
    return rows.withColumns({short: A.masked_softmax(F.col("strength"), F.col(f"in_{short}")) for _, short in _PAIRS})


_TAGS = {
    "em": "('EMOTION')",
    "mo": "('MODALITY', 'MODALITY_SCOPE')",
    "ne": "('NEGATION', 'NEGATION_SCOPE')",
}
_ATTENTION_SQL = f"""{B.TOKENS_SQL}, {B.sql_tagged('docs')},
raw AS (SELECT row_id, pos, token, channel, CASE WHEN hit THEN exp(s - max(s) FILTER (hit) OVER (PARTITION BY row_id, channel)) ELSE 0 END AS e FROM (
  SELECT row_id, pos, token, length(token) / 4 + pos / 1000 AS s, channel,
    CASE channel {' '.join(f"WHEN '{c}' THEN tag IN {t}" for c, t in _TAGS.items())} END AS hit
  FROM tagged, (VALUES ('em'), ('mo'), ('ne')) AS v(channel))),
alphas AS (SELECT *, e / nullif(sum(e) OVER (PARTITION BY row_id, channel), 0) AS alpha FROM raw)"""


#: Rows of token lists and attention in an Arrow batch.
BATCH_ROWS = 1000


@query(
    "top_words_by_channel",
    f"""WITH {_ATTENTION_SQL}, best AS (SELECT row_id, channel, trim(token) AS word, max(alpha) AS alpha FROM alphas
      WHERE alpha > 0 AND trim(token) NOT IN ('', '<num>', '<url>', '<allcaps>', '[CLS]', '[SEP]', '[PAD]') GROUP BY ALL)
    SELECT row_id, channel, CAST(nth AS INT) AS nth, word, round(alpha, 5) AS alpha FROM (
      SELECT *, row_number() OVER (PARTITION BY row_id, channel ORDER BY alpha DESC, word) AS nth FROM best) WHERE nth <= 4""",
)
def top_words_by_channel(spark, sf):
    channels = F.array(
        *[F.struct(F.lit(s).alias("channel"), F.col(s).alias("alpha")) for _, s in _PAIRS]
    )
    long = attention(spark, sf).select("row_id", "words", F.explode(channels).alias("c"))
    long = long.select(
        "row_id",
        F.col("c.channel").alias("channel"),
        F.inline_outer(F.arrays_zip(F.col("words").alias("word"), F.col("c.alpha").alias("alpha"))),
    ).withColumn("real", F.lit(1))
    top = rationale.top_words_long(long, ["row_id", "channel"])
    # Stored here, since the aggregate and full batches of lists do not fit an executor together.
    return settle(top.select("row_id", "channel", "nth", "word", F.round("alpha", 5).alias("alpha")), BATCH_ROWS)


def _tops(rows):
    ones = F.array_repeat(F.lit(1), F.size("words"))
    return {s: rationale.top_subwords(F.col(s), F.col("words"), ones, F.col(f"in_{s}")) for _, s in _PAIRS}


_TOP_SQL = f"""{_ATTENTION_SQL}, best AS (SELECT row_id, channel, token, alpha, row_number() OVER (PARTITION BY row_id, channel ORDER BY alpha DESC, pos) AS nth
  FROM alphas WHERE alpha > 0 AND token NOT IN ('[CLS]', '[SEP]', '[PAD]', '[UNK]')),
tops AS (SELECT d.row_id, {', '.join(f"coalesce(string_agg(printf('%s%s%s (α=%.2f)', chr(34), token, chr(34), alpha), ', ' ORDER BY nth) FILTER (channel = '{c}'), '{K.NO_TOKENS_TEXT}') AS t_{c}" for c in _TAGS)}
  FROM docs d LEFT JOIN best b ON d.row_id = b.row_id AND b.nth <= 5 GROUP BY d.row_id)"""


@query("top_subwords_by_channel", f"WITH {_TOP_SQL} SELECT * FROM tops")
def top_subwords_by_channel(spark, sf):
    rows = attention(spark, sf)
    return rows.select(
        "row_id", *[rationale.format_top_tokens(t).alias(f"t_{s}") for s, t in _tops(rows).items()]
    )


@query(
    "rationale_with_tokens",
    f"""WITH {B.SCORED_SQL}, {_TOP_SQL} SELECT s.row_id, concat_ws(chr(10), 'Statement: ' || claim, repeat('─', 72),
      {', '.join(f"{line}, '            Top tokens: ' || t_{s}" for line, (_, s) in zip(_LINES, _PAIRS))}, repeat('─', 72), {_VERDICT}) AS rationale
    FROM scored s JOIN tops t ON s.row_id = t.row_id""",
)
def rationale_with_tokens(spark, sf):
    words = attention(spark, sf)
    tops = words.select("row_id", *[t.alias(f"top_{s}") for s, t in _tops(words).items()])
    rows = B.scored(spark, sf).join(tops, "row_id")
    text = rationale.rationale_with_tokens(
        F.col("claim"),
        {s: F.col(s) for _, s in _PAIRS},
        {s: F.col(f"top_{s}") for _, s in _PAIRS},
        F.col("logit0"),
        F.col("logit1"),
    )
    return rows.select("row_id", text.alias("rationale"))


# -- curation ---------------------------------------------------------------------------------

_GOOD_SQL = f"""{B.SCORED_SQL},
good AS (SELECT *, CASE has_meta WHEN 1 THEN 'political' ELSE 'health' END AS domain FROM scored
  WHERE pred = label AND conf >= 0.7 AND greatest(em, mo, ne) >= 0.15),
turns AS (SELECT *, row_number() OVER (PARTITION BY domain, label ORDER BY greatest(em, mo, ne) DESC, row_id) AS rd FROM good),
chosen AS (SELECT *, CAST(row_number() OVER (ORDER BY rd, domain DESC, label) AS INT) AS example FROM turns QUALIFY example <= 8)"""


@query("curation_filter", f"WITH {_GOOD_SQL} SELECT row_id, label, round(conf, 6) AS conf FROM good")
def curation_filter(spark, sf):
    return curate.good_examples(B.scored(spark, sf)).select(
        "row_id", "label", F.round("conf", 6).alias("conf")
    )


@query("curated_round_robin", f"WITH {_GOOD_SQL} SELECT example, row_id, domain, label FROM chosen")
def curated_round_robin(spark, sf):
    chosen = curate.round_robin(curate.good_examples(B.scored(spark, sf)))
    return chosen.select("example", "row_id", "domain", "label")


def _channel_lines(i: int, s: str, title: str) -> str:
    lead = f"  Step {i} — {title} channel".ljust(29)
    return f"printf('{lead}(score=%.2f, %s)', {s}, {_BANDS.format(s=s)}), '           top tokens: ' || t_{s}, ''"


_CARD_LINES = ", ".join(
    _channel_lines(i, s, c.upper()) for i, (c, s) in enumerate(_PAIRS, 1)
)


@query(
    "curated_cards",
    f"""WITH {_GOOD_SQL}, {_ATTENTION_SQL},
    words4 AS (SELECT row_id, channel, trim(token) AS word, max(alpha) AS alpha FROM alphas
      WHERE alpha > 0 AND trim(token) NOT IN ('', '<num>', '<url>', '<allcaps>', '[CLS]', '[SEP]', '[PAD]') GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id, channel ORDER BY alpha DESC, word) AS nth FROM words4),
    lists AS (SELECT c.row_id, {', '.join(f"coalesce(string_agg(printf('%s%s%s (%.2f)', chr(34), word, chr(34), alpha), ', ' ORDER BY nth) FILTER (channel = '{c}'), '—') AS t_{c}" for c in _TAGS)}
      FROM chosen c LEFT JOIN ranked r ON c.row_id = r.row_id AND r.nth <= 4 GROUP BY c.row_id)
    SELECT example, row_id, concat_ws(chr(10), repeat('─', 71), printf('EXAMPLE %d  (%s · gold=%s · pred=%s · conf=%.2f)', example, upper(domain),
        CASE label WHEN 0 THEN 'fake' ELSE 'real' END, CASE pred WHEN 0 THEN 'fake' ELSE 'real' END, conf), repeat('─', 71),
      'Claim:', '  "' || claim || '"', '', 'Reasoning trace:', {_CARD_LINES}, '  Conclusion:', '    ' || {_HUMAN}, '') AS card
    FROM (SELECT c.*, l.* EXCLUDE (row_id), {_PHRASES} AS names FROM chosen c JOIN lists l ON c.row_id = l.row_id)""",
)
def curated_cards(spark, sf):
    chosen = curate.round_robin(curate.good_examples(B.scored(spark, sf)))
    rows = attention(spark, sf)
    channels = F.array(
        *[F.struct(F.lit(s).alias("channel"), F.col(s).alias("alpha")) for _, s in _PAIRS]
    )
    # Eight rows are left by now, so only their attention is computed.
    few = rows.join(F.broadcast(chosen.select("row_id")), "row_id", "left_semi")
    long = few.select("row_id", "words", F.explode(channels).alias("c")).select(
        "row_id",
        F.col("c.channel").alias("channel"),
        F.inline_outer(F.arrays_zip(F.col("words").alias("word"), F.col("c.alpha").alias("alpha"))),
    )
    tops = rationale.top_words_long(long.withColumn("real", F.lit(1)), ["row_id", "channel"])
    lists = tops.groupBy("row_id", "channel").agg(
        F.array_sort(F.collect_list(F.struct("nth", "word", "alpha"))).alias("words")
    )
    wide = lists.groupBy("row_id").pivot("channel", ["em", "mo", "ne"]).agg(F.first("words"))
    wide = wide.select("row_id", *[F.col(c).alias(f"top_{c}") for c in ("em", "mo", "ne")])
    none = F.array().cast("array<struct<nth:int,word:string,alpha:double>>")
    tops = {c: curate.format_words(F.coalesce(F.col(f"top_{c}"), none)) for c in ("em", "mo", "ne")}
    cards = chosen.join(wide, "row_id", "left")
    return cards.select("example", "row_id", curate.card_text(tops).alias("card"))
