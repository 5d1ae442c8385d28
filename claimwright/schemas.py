"""Explicit schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

# Header-less political claims, 14 columns by position.
RAW_POLITICAL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("statement", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("job", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("party", T.StringType()),
        T.StructField("barely_true_count", T.DoubleType()),
        T.StructField("false_count", T.DoubleType()),
        T.StructField("half_true_count", T.DoubleType()),
        T.StructField("mostly_true_count", T.DoubleType()),
        T.StructField("pants_fire_count", T.DoubleType()),
        T.StructField("context", T.StringType()),
    ]
)
POLITICAL_COLUMNS = [c for c in RAW_POLITICAL.names if c not in ("id", "job", "state")]

CONCEPT_COLUMNS = [
    "label", "statement", "subject", "speaker", "party",
    "barely_true_count", "false_count", "half_true_count", "mostly_true_count",
    "pants_fire_count", "context", "clean_statement", "normalized_text",
    "tokens", "truncated_tokens", "concept_tags", "binary_label",
]

DOMAIN_METRICS = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("n", T.LongType()),
            T.StructField("acc", T.DoubleType()),
            T.StructField("macro_f1", T.DoubleType()),
        ]
    ),
)

RESULT = T.StructType(
    [
        T.StructField("tag", T.StringType()),
        T.StructField("phase", T.IntegerType()),
        T.StructField("variant", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("L", T.IntegerType()),
        T.StructField("use_meta", T.BooleanType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("best_val_macro_f1", T.DoubleType()),
        T.StructField("test_acc", T.DoubleType()),
        T.StructField("test_macro_f1", T.DoubleType()),
        T.StructField("test_per_domain", DOMAIN_METRICS),
        T.StructField("em_mean", T.DoubleType()),
        T.StructField("mo_mean", T.DoubleType()),
        T.StructField("ne_mean", T.DoubleType()),
    ]
)

EPOCH = T.StructType(
    [
        T.StructField("tag", T.StringType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("epoch", T.IntegerType()),
        *[
            T.StructField(c, T.DoubleType())
            for c in (
                "train_loss", "main_loss", "aux_loss", "cov_loss", "val_loss", "val_acc",
                "val_macro_f1", "em_mean", "mo_mean", "ne_mean", "lr",
            )
        ],
    ]
)

RUN_LOG = T.StructType(
    [
        T.StructField("step", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("runtime", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.StringType())),
    ]
)


def check_schema(df, expected: T.StructType):
    """Raise if a column is missing or has another type."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [
        f"{f.name}: {have.get(f.name)} instead of {f.dataType}"
        for f in expected
        if have.get(f.name) != f.dataType
    ]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df
