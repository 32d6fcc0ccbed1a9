"""Ignore rules and language extensions as data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: ignore rules -------------------------------------------------------------
# Results must agree on these names. The sixth directory is this engine's own working folder.
IGNORE_DIRECTORIES = (
    ".git", ".github", ".vscode", ".idea", ".gitlab", ".sourcelode", "db", "node_modules",
    "__pycache__", "dist", "build", "benchmark", "bench", "dockerfiles", "target",
)
IGNORE_DIRECTORY_PREFIX = ("test", "Test")
IGNORE_DIRECTORY_SUFFIX = ("Test", "test", ".egg-info")
IGNORE_FILES = (
    "README.md", "LICENSE", "requirements.txt", "setup.py", "Dockerfile", "NOTICE", "Makefile",
    "Cargo.toml", "Cargo.lock", ".gitignore", ".dockerignore", ".gitattributes", ".editorconfig",
)
IGNORE_FILE_PREFIX = ("test", "Test")
IGNORE_FILE_SUFFIX = (
    "Test", "test", ".pyc", ".pyo", ".swp", ".log", ".tmp", ".bak", ".tmp", ".log", ".cache",
    ".egg-info", ".egg", ".md", ".json", ".yaml", ".toml", ".gz", ".zip", ".tar.gz", ".tar.bz2",
    ".tar.xz", ".rar", ".7z", ".iso", ".bin", ".exe", ".dll", ".so", ".dylib", ".lib", ".a", ".o",
    ".class", ".jar", ".war", ".ear", ".apk", ".ipa", ".aab", ".txt", ".template", ".md", ".png",
    ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".svg", ".webp", ".ico", ".pdf", ".doc",
    ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".csv", ".tsv", ".rst", ".tex", ".bib", ".bibtex",
    ".Dockerfile",
)

# ---- fixed values: languages and their extensions -------------------------------------------
LANGUAGE_EXTENSIONS: dict[str, tuple[str, ...]] = {
    "Python": (".py",),
    "Java": (".java",),
    "JavaScript": (".js", ".jsx"),
    "C": (".c", ".h"),
    "C++": (".cpp", ".hpp", ".cc", ".cxx", ".hxx"),
    "C#": (".cs",),
    "Ruby": (".rb", ".rbw"),
    "Go": (".go",),
    "Swift": (".swift",),
    "Kotlin": (".kt", ".kts"),
    "Rust": (".rs",),
    "TypeScript": (".ts", ".tsx"),
    "HTML": (".html", ".htm"),
    "CSS": (".css",),
    "PHP": (".php", ".phtml", ".php4", ".php3", ".php5", ".php7", ".phps", ".php-s"),
    "Perl": (".pl", ".pm", ".t", ".pod"),
    "R": (".r", ".rdata", ".rds", ".rda"),
    "Scala": (".scala", ".sc"),
    "Shell": (".sh", ".bash", ".zsh", ".csh", ".tcsh", ".ksh"),
    "Lua": (".lua",),
    "MATLAB": (".m", ".mlx"),
    "Groovy": (".groovy", ".grt", ".gtpl", ".gsp"),
    "Objective-C": (".m", ".mm", ".M", ".h"),
    "Assembly": (".asm", ".s"),
    "Haskell": (".hs", ".lhs"),
    "Julia": (".jl",),
    "Fortran": (".f", ".for", ".f90", ".f95", ".f03", ".f08", ".f15"),
    "Pascal": (".pas", ".pp", ".p", ".inc"),
    "SQL": (".sql",),
    "XML": (".xml",),
}
# ---- end of fixed values --------------------------------------------------------------------

UNKNOWN_LANGUAGE = "unknown"

RULE_KINDS = (
    "directories",
    "directory_prefix",
    "directory_suffix",
    "files",
    "file_prefix",
    "file_suffix",
)


@dataclass(frozen=True)
class IgnoreRules:
    """Six lists of patterns; an entry with a slash is a path below the project root, one that begins
    with a slash an absolute path."""

    directories: Sequence[str] = IGNORE_DIRECTORIES
    directory_prefix: Sequence[str] = IGNORE_DIRECTORY_PREFIX
    directory_suffix: Sequence[str] = IGNORE_DIRECTORY_SUFFIX
    files: Sequence[str] = IGNORE_FILES
    file_prefix: Sequence[str] = IGNORE_FILE_PREFIX
    file_suffix: Sequence[str] = IGNORE_FILE_SUFFIX

    @classmethod
    def from_frame(cls, catalog: DataFrame) -> IgnoreRules:
        """Read a catalog of ``(kind, pattern)`` rows; it is configuration, not data."""
        found: dict[str, list[str]] = {kind: [] for kind in RULE_KINDS}
        for row in catalog.select("kind", "pattern").distinct().orderBy("kind", "pattern").toLocalIterator():
            found[row["kind"]].append(row["pattern"])
        return cls(**found)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(kind, pattern) for kind in RULE_KINDS for pattern in dict.fromkeys(getattr(self, kind))]
        return spark.createDataFrame(rows, "kind string, pattern string")


NO_RULES = IgnoreRules((), (), (), (), (), ())


def language_frame(
    spark: SparkSession, languages: Mapping[str, Sequence[str]] = LANGUAGE_EXTENSIONS
) -> DataFrame:
    """``(language, priority, exts)``, one row per language in catalog order."""
    rows = [(name, i, list(exts)) for i, (name, exts) in enumerate(languages.items())]
    return spark.createDataFrame(rows, "language string, priority int, exts array<string>")


def invert(languages: DataFrame) -> DataFrame:
    """``language -> [ext]`` to ``ext -> language``; the earlier language wins a shared extension."""
    return (
        languages.select("language", "priority", F.explode("exts").alias("ext"))
        .groupBy("ext")
        .agg(F.min_by("language", "priority").alias("language"))
    )


def regroup(extensions: DataFrame) -> DataFrame:
    """``ext -> language`` back to ``language -> [ext]``."""
    return extensions.groupBy("language").agg(F.array_sort(F.collect_set("ext")).alias("exts"))


def extension_frame(
    spark: SparkSession, languages: Mapping[str, Sequence[str]] = LANGUAGE_EXTENSIONS
) -> DataFrame:
    """``(ext, language)`` as literal rows, so that joins against it need no shuffle of their own."""
    first: dict[str, str] = {}
    for name, exts in languages.items():
        for ext in exts:
            first.setdefault(ext, name)
    return spark.createDataFrame(list(first.items()), "ext string, language string")


def save_catalog(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").parquet(path)


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
