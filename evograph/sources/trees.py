"""Source trees: reading files, and symbols, imports and exports of their texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .outline import complexity, lines_of, outline

# Folders and endings of files that a scan leaves out.
FOLDERS = (
    "node_modules", "dist", "build", ".git", "coverage", ".pnpm-store", ".pnpm", "vendor", ".next", ".nuxt", "playwright-report", ".history", "out", ".turbo", ".vercel", ".cache", "temp", ".tmp", "generated", "swagger",
    "prisma/client",
)
ENDINGS = (".d.ts", ".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx", ".generated.ts", ".generated.tsx")
EXCLUDED = rf"(?:^|/)(?:{'|'.join(map(re.escape, FOLDERS))})/|(?:{'|'.join(map(re.escape, ENDINGS))})$"


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, content, modified_us) of the source files below a folder; excluded ones are dropped before their content is used."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ts,tsx,js,jsx}").load(root)
    )
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{re.escape(root.rstrip('/'))}/", "")
    return files.select(path.alias("file_path"), F.unix_micros("modificationTime").alias("modified_us"), F.col("content").cast("string").alias("content")).where(~F.col("file_path").rlike(EXCLUDED))


def language_of(path: Column) -> Column:
    """Language of a path's extension; javascript for any other."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.when(ext == "ts", "typescript").when(ext == "tsx", "tsx").when(ext == "jsx", "jsx").otherwise("javascript")


SYMBOL = (
    "id string, node_type string, name string, file_path string, line_start int, line_end int, exported boolean, complexity int, documentation string, parameters array<string>, return_type string,"
    " is_async boolean, is_generator boolean, is_abstract boolean, extends_name string, implements_names array<string>, member_count int"
)
IMPORT = "module string, symbols array<string>, is_default boolean, is_namespace boolean, is_type_only boolean"
EXPORT = "name string, is_default boolean, is_re_export boolean, source string"
SCAN = f"file_path string, line_count int, error string, symbols array<struct<{SYMBOL.replace(' ', ':').replace(',:', ',')}>>, imports array<struct<{IMPORT.replace(' ', ':').replace(',:', ',')}>>, exports array<struct<{EXPORT.replace(' ', ':').replace(',:', ',')}>>"


def scan_text(path: str, text: str | None) -> tuple:
    """What a file declares, imports and exports, in the columns of SCAN.

    A symbol's id is its path, type, name and line. Its documentation is the descriptions of the documentation comments before
    it. Complexity, of functions and classes, is one more than the branches, and than the binary expressions in whose
    text a logical operator stands, so that an expression around a logical one counts as well.
    """
    text = (text or "").replace("\r\n", "\n")
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else "ts"
    o = outline(text, {"mjs": "js", "cjs": "js", "mts": "ts", "cts": "ts"}.get(ext, ext))
    line = lines_of(text)
    symbols = []
    for x in o.symbols:
        at = line(x.start)
        symbols.append(
            dict(
                id=f"{path}:{x.kind}:{x.name}:{at}", node_type=x.kind, name=x.name, file_path=path, line_start=at, line_end=line(max(x.end - 1, x.start)), exported=x.exported,
                complexity=complexity(o, x) if x.counted else None, documentation=x.documentation, parameters=x.parameters, return_type=x.return_type, is_async=x.is_async, is_generator=x.is_generator,
                is_abstract=x.is_abstract, extends_name=x.extends, implements_names=x.implements, member_count=x.members,
            )
        )
    imports = [dict(zip(("module", "symbols", "is_default", "is_namespace", "is_type_only"), x)) for x in o.imports]
    exports = [dict(name=n, is_default=d, is_re_export=m is not None, source=m) for n, d, m in o.exports]
    own = [("default" if x.default else x.name, x.default) for x in o.symbols if x.exported and "." not in x.name and (x.default or x.name not in {a for a, _ in o.renamed})]
    exports += [dict(name=n, is_default=d, is_re_export=False, source=None) for n, d in [*own, *((b, False) for _, b in o.renamed if b != "default")]]
    return path, text.count("\n") + (not text.endswith("\n") and text != ""), o.errors[0][0] if o.errors else None, symbols, imports, exports


def scan(files: DataFrame) -> DataFrame:
    """One row a file (file_path, content) with its lines, first syntax error, symbols, imports and exports.

    Every text is walked once by the grammar of its extension. Repeated paths count once, null paths are left out, null
    and empty contents declare nothing.
    """

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file_path", "line_count", "error", "symbols", "imports", "exports"]
        for frame in frames:
            yield pd.DataFrame([scan_text(p, t) for p, t in zip(frame.file_path, frame.content)], columns=names)

    once = spread(files.select("file_path", "content").where("file_path IS NOT NULL"), "file_path").dropDuplicates(["file_path"])
    return once.mapInPandas(f, SCAN)


def symbols_of(scanned: DataFrame) -> DataFrame:
    """S3: the symbols of scanned files, one row each."""
    return scanned.select(F.explode("symbols").alias("s")).select("s.*")


def imports_of(scanned: DataFrame) -> DataFrame:
    """(file_path, module, symbols, is_default, is_namespace, is_type_only), one row per import declaration of a relative module; packages are dropped."""
    return scanned.select("file_path", F.explode("imports").alias("i")).select("file_path", "i.*").where(F.col("module").startswith(".") | F.col("module").startswith("/"))


def exports_of(scanned: DataFrame) -> DataFrame:
    """(file_path, name, is_default, is_re_export, source): names in export lists, defaults, and exported declarations.

    A name that is declared and listed comes twice, the second time under the name it is exported by.
    """
    return scanned.select("file_path", F.explode("exports").alias("e")).select("file_path", "e.*")


def extract_symbols(files: DataFrame) -> DataFrame:
    """S3 for a table of files (file_path, content)."""
    return symbols_of(scan(files))


def extract_imports(files: DataFrame) -> DataFrame:
    """S6 for a table of files (file_path, content)."""
    return imports_of(scan(files))


def extract_exports(files: DataFrame) -> DataFrame:
    """S8 for a table of files (file_path, content)."""
    return exports_of(scan(files))


def resolve(path: Column, module: Column) -> Column:
    """The path a relative module means; without an extension it is .ts, with one it stays as it is."""
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    parts = F.split(F.concat_ws("/", folder, module), "/")
    walk = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when((x == ".") | (x == ""), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    out = F.array_join(walk, "/")
    return F.when(out.rlike(r"\.(?:ts|tsx|js|jsx)$"), out).otherwise(F.concat(out, F.lit(".ts")))
