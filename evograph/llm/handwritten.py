"""Files nobody wrote by hand: generated, compiled, bundled, minified, vendored, or data stored as code.

The evidence is layout: maximum and mean line length, shares of white space and of letters and digits, density
of numeric literals, long encoded runs, the share of text on lines that hold nothing but literals, and how few
shapes of line a file is made of. Thresholds are set per language. Banners in a file's leading comment and the
folders that package managers own complete it; a word in a string, in the middle of a file or in part of a
folder's name is no evidence. The statistics need one pass over a text; the thresholds are plain columns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread


@dataclass(frozen=True)
class Limits:
    """Thresholds of one language."""

    mean_line: float = 180.0  # characters of an average line that isn't blank, from which code is minified ...
    dense_space: float = 0.13  # ... if its share of white space is below this
    long_line: int = 1500  # one line as long as this, with as little space, is minified as well
    repeated: float = 0.9  # share of lines whose shape occurs at least four times
    shapes: float = 0.27  # distinct shapes of line per line, at most, of generated code
    lines: int = 18  # lines, at least, for statements about repetition
    keywords: float = 0.2  # code words per line, at least, for generated code
    digits: float = 0.55  # share of digits among all characters but white space, of data
    literal_share: float = 0.7  # share of text on lines of literals only, of data
    literal_lines: int = 20  # such lines, at least; a hand-kept table is shorter
    blob: int = 400  # characters of one literal or encoded run, at least ...
    blob_share: float = 0.5  # ... and its share of the file


#: What differs between the languages, each for a reason of its layout.
LIMITS = {
    # types make lines of hand-written code longer, but no bundler writes TypeScript, so that dense text is telling earlier;
    # declaration files repeat shapes that plain keywords don't mark (members with types), so fewer words do
    "ts": Limits(mean_line=160, long_line=1200, keywords=0.15),
    # markup runs long and is indented deeply, so dense means less white space; icons are drawn by one long path
    # literal in a hand-written component; lists of elements repeat a shape by nature
    "tsx": Limits(mean_line=200, dense_space=0.12, blob=600, blob_share=0.6, repeated=0.92),
    # what bundlers and minifiers write
    "js": Limits(),
    "jsx": Limits(mean_line=200, dense_space=0.12, blob=600, blob_share=0.6, repeated=0.92),
}

# Phrases of generators' banners, in the languages they are met in.
GENERATED = (
    r"@generated\b|\bauto[- ]?generated\b|\bautomatically (?:generated|produced|created|written)|\bcode generated by\b|\bgenerated (?:code|file)\b|\bdo not (?:edit|modify|change)\b(?! the licen[cs]e)"
    r"|\bmachine generated\b|\bchanges will be (?:lost|overwritten)|\bautomatisch (?:erzeugt|generiert|erstellt)|\bnicht von hand\b|\bgenerado autom|\bno editar\b|\bg[eé]n[eé]r[eé] autom|\bne pas modifier"
    r"|^\W*source: \S+\.(?:proto|thrift|graphql|avsc|yaml|yml|json|idl|wsdl|xsd)\s*$|\btest snapshot v\d"
)
# Phrases of headers on copies of other projects' files.
VENDORED = (
    r"^\W*[\w@./-]+ v?\d+\.\d+\.\d+\W*$|\bcopied (?:unchanged |verbatim |as is )?from [\w@./-]+|^\W*upstream: |\bnot maintained here\b|\bsnapshot of [\w@./-]+ \d|\bvendored (?:from|copy)\b"
    r"|\(c\) the [\w-]+ contributors\b|\bfix bugs upstream\b|\blocal changes will be lost\b|\btaken from [\w@./-]+@?\d|\bthird[- ]party (?:code|file|copy)\b"
)
# What a hand-written file says about another, generated one.
BY_HAND = r"\bedited by hand\b|\bwritten by hand\b|\bhand[- ]written\b|\bmaintained by hand\b|\bonly reads it\b"
# Folders that package managers and conventions set aside for other people's code.
FOREIGN = r"/(?:node_modules|bower_components|jspm_packages|third[_-]party|vendor|vendors|external|externals|Pods|\.yarn)/"
# Words of code, by which repeated code is told from repeated text.
KEYWORDS = re.compile(r"\b(?:get|set|return|function|class|exports|export|case|var|const|public|this|module|Object|Array)\b")

STRING = re.compile(r"'[^'\n]*'|\"[^\"\n]*\"")
NUMBER = re.compile(r"(?<![\w.])-?\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?\b|\b(?:true|false|null)\b")
DATA_LINE = re.compile(r"[\sSN:,;\[\]{}]*[SN][\sSN:,;\[\]{}]*")
WORDS = re.compile(r"\w+")
QUOTED = re.compile(r"(?m)^(?:\ufeff|> |\d{1,5}\| )")
ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{100,}")
LITERAL = re.compile(r"'[^'\n]{200,}'|\"[^\"\n]{200,}\"|`[^`\n]{200,}`")
COMMENT = re.compile(r"[\s>+\-]*\ufeff?(?://|/\*|\*|#!|<!--)")
WRAPPED = re.compile(r"(?m)^\s*/\*{3}/|\((?:module|__unused_\w+), (?:exports|__\w+)(?:, \w+)?\) (?:=>|\{)")
COMPILED = re.compile(r"\"__esModule\"|'__esModule'|\(this && this\.__\w+\)|/\*\* @class \*/|\b__(?:awaiter|generator|extends|decorate)\(|\b_interopRequire\w+\(")
SNAPSHOT = re.compile(r"(?m)^exports\[`")

#: Ends of block comments by their beginnings.
BLOCKS = {"/*": "*/", "<!--": "-->"}
BLOCK = re.compile(r"/\*|<!--|//")


# What stands before the first statement of a file's own: directives, and lines of imports.
PREAMBLE = re.compile(r"[\s>+\-]*\ufeff?(?:['\"]use \w+['\"];?\s*$|import\b[^;]*['\"];?\s*$|(?:const|var|let)\b[^=;]*=\s*require\([^)]*\);?\s*$)")

IMPORTS = re.compile(r"\s*import\b[^'\"{}]*\{[^}]*$")


def leading_comment(lines: list[str]) -> str:
    """The comments before the first code of a file's own, to their ends, however many; directives and imports may lie
    between them. lines are not blank."""
    out = []
    end = None
    imports = False  # within the braces of an import
    for x in lines:
        rest = x
        if imports or end is None and IMPORTS.match(x):
            imports = "}" not in x
            continue
        if end is None and not COMMENT.match(x):
            if PREAMBLE.match(x):
                continue
            break
        out.append(x)
        # what is open at the end of the line, and whether code follows within it
        while rest:
            if end is not None:
                at = rest.find(end)
                if at < 0:
                    break
                rest, end = rest[at + len(end) :], None
            m = BLOCK.search(rest)
            if m is None or rest[: m.start()].strip(" \t>+-\ufeff") or m.group() == "//":
                break
            rest, end = rest[m.end() :], BLOCKS[m.group()]
        if end is None and rest.strip() and not COMMENT.match(rest):
            break
    return "\n".join(out)


STATISTICS = (
    "n_lines int, max_line int, mean_line double, space double, alnum double, digits double, numbers double, encoded int, literal int, n_chars int,"
    " repeated double, shapes double, literal_lines int, literal_share double, keywords double, header string, wrapped int, compiled int, snapshots int"
)


def layout(text: str | None) -> tuple:
    """The layout statistics of a text, in the order of STATISTICS; zeros for blank texts."""
    # what was put before every line when a text was quoted or numbered is no part of its layout
    text = QUOTED.sub("", (text or "").replace("\r\n", "\n").replace("\r", "\n"))
    lines = [x for x in text.split("\n") if x.strip()]
    dense = "".join(text.split())
    size, width = max(len(dense), 1), max(len(lines), 1)
    shapes = Counter(WORDS.sub("w", x.strip()) for x in lines)
    data = [x for x in lines if DATA_LINE.fullmatch(NUMBER.sub("N", STRING.sub("S", x)))]
    longest = lambda p: max((len(m.group()) for m in p.finditer(text)), default=0)
    return (
        len(lines), max(map(len, lines), default=0), len(text) / width, 1 - len(dense) / max(len(text), 1),
        sum(c.isascii() and c.isalnum() for c in dense) / size, sum(c in "0123456789" for c in dense) / size,
        len(NUMBER.findall(text)) / max(len(WORDS.findall(text)), 1), longest(ENCODED), longest(LITERAL), len(text),
        sum(n for n in shapes.values() if n >= 4) / width, len(shapes) / width, len(data), len("".join("".join(data).split())) / size,
        len(KEYWORDS.findall(text)) / width, leading_comment(lines),
        len(WRAPPED.findall(text)), len(COMPILED.findall(text)), len(SNAPSHOT.findall(text)),
    )


def _statistics(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["file_id", "repo", "file_path", *(x.split()[0] for x in STATISTICS.split(", "))]
    for f in frames:
        yield pd.DataFrame([(i, r, p, *layout(t)) for i, r, p, t in zip(f.file_id, f.repo, f.file_path, f.content)], columns=names)


def statistics(files: DataFrame) -> DataFrame:
    """Rows (file_id, repo, file_path, ext, ...STATISTICS), one per file_id."""
    once = spread(files.select("file_id", "repo", "file_path", "content"), "file_id").dropDuplicates(["file_id"])
    ext = F.lower(F.regexp_extract(F.coalesce("file_path", F.lit("")), r"\.([A-Za-z]+)$", 1))
    return once.mapInPandas(_statistics, f"file_id long, repo string, file_path string, {STATISTICS}").withColumn("ext", ext)


def not_handwritten(files: DataFrame, limits: dict[str, Limits] = LIMITS) -> DataFrame:
    """Rows (file_id, repo, file_path, reason, ...statistics) of the files that nobody wrote by hand.

    files: file_id, repo, file_path, content; repeated rows of a file_id count once, other columns are
    ignored. reason is the first that holds of: vendored, generated, bundled, compiled, data, minified,
    repetition, foreign folder (the place alone: a folder that a package manager owns, by its exact name). Null, empty and blank contents are no case (but for a path in a foreign folder), a null path has no
    language and gets the thresholds of plain scripts.
    """
    s = statistics(files)
    by = lambda f: F.coalesce(*[F.when(F.col("ext") == k, F.lit(float(getattr(v, f)))) for k, v in limits.items()], F.lit(float(getattr(limits["js"], f))))
    header = F.regexp_replace("header", r"\s*\*/\s*$", "")
    banner = lambda p: header.rlike("(?im)" + p) & ~header.rlike("(?i)" + BY_HAND)
    few_shapes = (F.col("repeated") >= by("repeated")) & (F.col("shapes") <= by("shapes")) & (F.col("n_lines") >= by("lines")) & (F.col("keywords") >= by("keywords"))
    dense = F.col("space") < by("dense_space")
    reason = F.coalesce(
        F.when(banner(VENDORED) & ~banner(GENERATED) & (F.col("mean_line") < by("mean_line")), "vendored"),
        F.when(banner(GENERATED) | (F.col("snapshots") >= 2), "generated"),
        F.when(F.col("wrapped") >= 3, "bundled"),
        F.when(F.col("compiled") >= 2, "compiled"),
        F.when((F.col("digits") >= by("digits")) & (F.col("n_chars") >= by("blob")) | (F.greatest("encoded", "literal") >= by("blob")) & (F.greatest("encoded", "literal") / F.col("n_chars") >= by("blob_share"))
               | (F.col("literal_lines") >= by("literal_lines")) & (F.col("literal_share") >= by("literal_share")), "data"),
        F.when(dense & ((F.col("mean_line") >= by("mean_line")) | (F.col("max_line") >= by("long_line"))), "minified"),
        F.when(few_shapes, "repetition"),
        F.when(F.concat(F.lit("/"), "file_path").rlike(FOREIGN), "foreign folder"),
    )
    columns = [c for c in s.columns if c not in ("header", "file_id", "repo", "file_path")]
    return s.withColumn("reason", reason).where("reason IS NOT NULL").select("file_id", "repo", "file_path", "reason", *columns)
