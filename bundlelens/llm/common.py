"""What several operators share: words, column names, and work on texts in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bundlelens.session import written

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
PIECE_BYTES = 1 << 20
"""Text that a Python worker holds as objects at a time; one longer text is a piece of its own."""


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(quoted(name))


def carried(df: DataFrame, carry, results) -> list[str]:
    """The columns to carry along: those named, or all; a column named like a result gives way to it."""
    taken = {name.lower() for name in results}
    return [name for name in (df.columns if carry is None else carry) if name.lower() not in taken]


def ascii_lower(column):
    """A-Z in lower case, everything else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text):
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def pieces(batch: pa.RecordBatch, column: int, limit: int = PIECE_BYTES):
    """Slices of a batch whose texts take about ``limit`` bytes, so that memory is bounded."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def annotate(df: DataFrame, text: str, fields, make, carry=None) -> DataFrame:
    """Adds the columns ``fields`` ((name, type) pairs), computed from a text column in Arrow batches.

    ``make()`` runs once per task and gives a function from a list of texts (or None) to one list
    per field. The carried columns pass through unchanged; there is no shuffle. A carried column
    named like a result gives way to it.
    """
    keep = carried(df, carry, [name for name, _ in fields])
    kinds_of = [T.DataType.fromDDL(kind) for _, kind in fields]
    schema = T.StructType([T.StructField(f"c{i}", df.schema[name].dataType) for i, name in enumerate(keep)]
                          + [T.StructField(f"r{i}", kind) for i, kind in enumerate(kinds_of)])
    columns = [col(name).alias(f"c{i}") for i, name in enumerate(keep)]
    at = keep.index(text) if text in keep else len(keep)
    if at == len(keep):
        columns.append(col(text).alias("t"))
    width, names = len(keep), schema.names
    sample = [kind for _, kind in fields]

    def run(batches):
        step = make()
        kinds = [ARROW[name] for name in sample]
        for batch in batches:
            for piece in pieces(batch, at):
                found = step(piece.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(i) for i in range(width)]
                    + [pa.array(values, kind) for values, kind in zip(found, kinds)], names=names)

    out = df.select(*columns).mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(keep)],
                      *[F.col(f"r{i}").alias(name) for i, (name, _) in enumerate(fields)])


_HELD: dict = {}


def held(name, build):
    """What ``build()`` makes, kept by a Python worker for its next tasks until it needs something else."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = build()
    return _HELD[name]


def _from_files(df: DataFrame) -> bool:
    """Whether the rows come straight from Parquet files, filtered or projected at most."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if not plan.nodeName().startswith("LogicalRelation"):
        return False
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def placed(df: DataFrame, **columns) -> DataFrame:
    """The given columns with ``_file`` and ``_row``, which tell rows apart and are the same whenever the table is read again.

    So what is decided about rows can be joined to their texts without storing those. A table that isn't read straight from
    Parquet files is stored first.
    """
    picked = [column.alias(name) for name, column in columns.items()]
    if not _from_files(df):
        df, picked = written(df.select(*picked), "rows"), list(columns)
    return df.select(*picked, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def with_texts(decided: DataFrame, base: DataFrame, text: str) -> DataFrame:
    """The rows of ``decided`` with the column ``text`` of ``base``, both made by ``placed`` from the same table."""
    texts = base.select(text, F.col("_file").alias("_of_file"), F.col("_row").alias("_of_row"))
    return decided.join(texts, (F.col("_row") == F.col("_of_row")) & (F.col("_file") == F.col("_of_file"))).drop("_of_file", "_of_row")


def renamed(df: DataFrame, keep, *needed):
    """The carried columns as ``k0``, ``k1``, …, and where the needed ones are among them (else added as ``n0``, …)."""
    columns, places = [col(name).alias(f"k{i}") for i, name in enumerate(keep)], []
    for i, name in enumerate(needed):
        if name in keep:
            places.append(f"k{keep.index(name)}")
        else:
            columns.append(col(name).alias(f"n{i}"))
            places.append(f"n{i}")
    return df.select(*columns), places


def restored(keep):
    """The columns of ``renamed`` under their own names."""
    return [F.col(f"k{i}").alias(name) for i, name in enumerate(keep)]


ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
    "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
    "array<struct<kind:string,start:int,end:int,layer:string>>": pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layer", pa.string())])),
}
