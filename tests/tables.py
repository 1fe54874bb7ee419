"""Small variants of the base tables: empty ones, and ones full of nulls, repeated rows and foreign columns."""

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq

SOURCE = "/root/testdata/sf0.001"


def variant(kind: str, folder: str) -> str:
    for p in glob.glob(f"{SOURCE}/*.parquet"):
        t = pq.read_table(p)
        if kind == "empty":
            t = t.slice(0, 0)
        else:
            schema = pa.schema([pa.field(f.name, f.type, True) for f in t.schema])
            head = t.slice(0, 30).cast(schema)
            parts = [head, head.slice(0, 5), pa.table({c: pa.nulls(3, schema.field(c).type) for c in t.column_names}, schema=schema)]
            for i, c in enumerate(t.column_names):
                parts.append(head.slice(0, 2).set_column(i, schema.field(c), pa.nulls(2, schema.field(c).type)))
            t = pa.concat_tables(parts)
            for extra in ("rn", "_rn", "k", "n", "score", "total", "line", "rank", "hash_", "component"):
                if extra not in t.column_names:
                    t = t.append_column(extra, pa.array(["x"] * len(t)))
        pq.write_table(t, os.path.join(folder, os.path.basename(p)))
    return folder
