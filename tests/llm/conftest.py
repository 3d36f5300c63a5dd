import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()),
                  ("source", pa.string()), ("n_chars", pa.int64())])


@pytest.fixture()
def docs(spark):
    """A documents table with clashing extra columns from (doc_id, text[, lang[, source]]) rows."""
    def build(rows):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, *[None] * (4 - len(row)))
            full.append((doc_id, text, lang, source, None if text is None else len(text), 1, "x", 2, 3))
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, "
                  "size long, `row` string, n_words long, rid long")
    return build


@pytest.fixture()
def tables(tmp_path):
    """Writes documents (and benchmark, embeddings) as Parquet and returns the folder."""
    def build(rows, **others):
        columns = list(zip(*[(*r, *[None] * (4 - len(r))) for r in rows], strict=True)) or [[]] * 4
        columns = [*columns, [None if t is None else len(t) for t in columns[1]]]
        pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, DOCS, strict=True)], schema=DOCS),
                       os.path.join(tmp_path, "documents.parquet"))
        for name, table in others.items():
            pq.write_table(table, os.path.join(tmp_path, f"{name}.parquet"))
        return str(tmp_path)
    return build
