"""Fill-in-middle transformation: DuckDB inside mapInArrow, no Python per row.

Every text is cut into lines (an unfinished last line counts) and those into prefix, middle and suffix at two
places drawn from the SHA-256 of "<seed>:<doc_id>"; the parts are written behind sentinels, suffix last
("psm") or first ("spm"). Each Arrow block of texts is registered with an in-memory DuckDB connection of the
task, whose SQL cuts, joins, rebuilds and digests it; the result goes back as Arrow. A block holds about BLOCK_BYTES of
text (one text at least), so a task's memory follows its longest text and not the table. No shuffle.

A text whose form is plain is given unchanged: empty ones, those that hold a sentinel, and those that the rate leaves out.
restored_sha256 is taken from the text rebuilt from output and form alone.

Defined cases: a null text is empty; a null doc_id is the empty string in the seed; repeated rows give equal rows; a
text of one line may have empty parts; a text of line feeds only is cut like any other; an
empty table gives no rows; other columns are not looked at and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm import text as tx

SEED = 7
#: Of 100 documents, those that are transformed, and of those the ones in spm order.
RATE, SPM = 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK_BYTES = 4 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def statement(table: str, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> str:
    """DuckDB SQL that transforms the table's columns doc_id and text."""
    if not (isinstance(seed, int) and 0 <= rate <= 100 and 0 <= spm <= 100):
        raise ValueError("seed is an integer, rate and spm are of 100")
    draw = lambda k: f"('0x' || substr(draws, {8 * k + 1}, 8))::BIGINT"
    part = lambda text, mark, k: f"split_part({text}, '{mark}', {k})"
    behind = f"substr(output, {len(PREFIX) + 1})"
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS draws,
         regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines
  FROM {table}),
drawn AS (
  SELECT doc_id, text, lines, len(lines)::BIGINT AS n, {draw(0)} % (len(lines) + 1) AS one, {draw(1)} % (len(lines) + 1) AS two,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {draw(2)} % 100 >= {rate} THEN 'plain'
              WHEN {draw(3)} % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form
  FROM texts),
cut AS (
  SELECT doc_id, text, n, form, array_to_string(list_slice(lines, 1, least(one, two)), '') AS prefix,
         array_to_string(list_slice(lines, least(one, two) + 1, greatest(one, two)), '') AS middle,
         array_to_string(list_slice(lines, greatest(one, two) + 1, n), '') AS suffix
  FROM drawn),
formed AS (
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
         CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
              ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
  FROM cut)
SELECT doc_id, n, form, prefix_chars::BIGINT AS prefix_chars, middle_chars::BIGINT AS middle_chars, output, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
         WHEN 'psm' THEN {part(behind, SUFFIX, 1)} || {part(part("output", SUFFIX, 2), MIDDLE, 2)} || {part(part("output", SUFFIX, 2), MIDDLE, 1)}
         ELSE {part(part("output", PREFIX, 2), MIDDLE, 1)} || {part("output", MIDDLE, 2)} || {part(behind, PREFIX, 1)} END) AS restored_sha256
FROM formed"""


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """One row per document, with the transformed text as output; see the module's text."""
    sql = statement("block", seed, rate, spm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        database = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        for batch in batches:
            for part in tx.blocks(batch, "text", BLOCK_BYTES):
                database.register("block", pa.Table.from_batches([part]))
                yield from database.sql(sql).to_arrow_table().to_batches()
                database.unregister("block")
        database.close()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, SCHEMA)
