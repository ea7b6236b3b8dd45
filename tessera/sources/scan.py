"""Files under roots as rows: listing, the rules of what is taken, and reading."""

from __future__ import annotations

import os
import re
import subprocess
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import glob_regex, is_binary, matches_any, normalized_lines, stable_id
from tessera.settings import Settings

# Files that are taken, files and directories that never are.
INCLUDE = (
    "**/*.md", "**/*.mdx", "**/*.txt", "**/*.rst", "**/*.pdf", "**/*.py", "**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.go", "**/*.rs", "**/*.java", "**/*.kt", "**/*.kts", "**/*.c", "**/*.cc",
    "**/*.cpp", "**/*.cxx", "**/*.cu", "**/*.cuh", "**/*.h", "**/*.hpp", "**/*.hh", "**/*.cs", "**/*.rb", "**/*.php", "**/*.swift", "**/*.scala", "**/*.json", "**/*.yaml", "**/*.yml", "**/*.toml",
    "**/*.sql", "**/*.sh", "**/*.bash", "**/*.zsh", "**/*.dockerfile", "**/Dockerfile",
)
EXTENSIONS = (
    ".md", ".mdx", ".txt", ".rst", ".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".go", ".rs", ".java", ".kt", ".kts", ".c", ".cc", ".cpp", ".cxx", ".cu", ".cuh", ".h", ".hpp", ".hh", ".cs",
    ".rb", ".php", ".swift", ".scala", ".json", ".yaml", ".yml", ".toml", ".sql", ".sh", ".bash", ".zsh", ".dockerfile", ".ini", ".cfg", ".pdf",
)
SECRETS = (".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa", "id_rsa.*", "id_ed25519", "id_ed25519.*", ".npmrc", ".pypirc", "credentials", "credentials.*", "secrets.*")
EXCLUDED_DIRS = (
    ".git", ".hg", ".svn", ".rag", ".index", ".indexes", ".venv", "venv", "env", ".env", "virtualenv", "node_modules", "bower_components", "dist", "build", "out", "target", "coverage", "htmlcov",
    ".next", ".nuxt", ".svelte-kit", ".turbo", ".parcel-cache", ".cache", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".nox", ".uv", ".eggs", "*.egg-info", "__pycache__", ".ipynb_checkpoints",
    ".idea", ".vscode", "vendor", "contrib", "third_party", "external", "site-packages", "dist-packages", "models", ".models", "checkpoints", ".checkpoints", "huggingface", ".huggingface", "transformers",
    ".transformers",
)


def accepted(path: Column, size: Column, settings: Settings, hidden_dirs: bool = False) -> Column:
    """If a file (its path relative to the root) is taken. hidden_dirs: take what is in directories that start with a dot."""
    name, parts = F.element_at(F.split(path, "/"), -1), F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    secret = matches_any(name, SECRETS) | matches_any(path, SECRETS)
    closed = F.exists(dirs, lambda d: d.rlike("|".join(f"(?:{glob_regex(g)})" for g in EXCLUDED_DIRS)) | (F.lit(not hidden_dirs) & d.startswith(".")))
    extension = F.lower(F.regexp_extract(name, r"(?s).(\.[^.]*)$", 1))
    small = size <= F.when(extension == ".pdf", settings.max_pdf_bytes).otherwise(settings.max_file_bytes)
    return ~secret & ~closed & small & (matches_any(path, INCLUDE) | extension.isin(*EXTENSIONS))


#: Files that are opened by name at most.
NAMED_FILES = 10_000


def _escaped(uri: str) -> str:
    """A path in which nothing is a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", uri)


def _root_uri(root: str) -> str:
    return root if "://" in root else "file:" + os.path.abspath(root)


def list_files(spark: SparkSession, roots: list[str], settings: Settings | None = None) -> DataFrame:
    """(root, path, uri, size_bytes, mtime_ns) of the files taken under the roots, each file once. Content is not read: the reader prunes that column."""
    settings = settings or Settings()
    found = None
    for root in roots:
        base = _root_uri(root).rstrip("/")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
        plain = base.split("://", 1)[-1].removeprefix("file:")
        at = F.instr(F.col("path"), plain + "/") + len(plain) + 1
        rows = files.select(F.lit(root).alias("root"), F.substr("path", at).alias("rel"), F.col("path").alias("uri"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no roots")
    found = found.withColumnRenamed("rel", "path").where(accepted(F.col("path"), F.col("size_bytes"), settings))
    return found.dropDuplicates(["uri"]) if len(roots) > 1 else found


def git_files(spark: SparkSession, root: str, settings: Settings | None = None) -> DataFrame:
    """The files of a git work tree (tracked, and untracked but not ignored), listed on the driver, with the same columns as list_files."""
    settings = settings or Settings()
    listed = subprocess.run(["git", "-C", root, "ls-files", "-co", "--exclude-standard", "-z"], capture_output=True, check=True).stdout.decode().split("\0")
    rows = []
    for path in dict.fromkeys(x for x in listed if x):
        full = os.path.join(root, path)
        if os.path.isfile(full) and os.path.realpath(full).startswith(os.path.realpath(root) + os.sep):
            st = os.stat(full)
            rows.append((root, path, "file:" + os.path.abspath(full), st.st_size, st.st_mtime_ns))
    files = spark.createDataFrame(rows, "root string, path string, uri string, size_bytes long, mtime_ns long")
    return files.where(accepted(F.col("path"), F.col("size_bytes"), settings, hidden_dirs=True))


@dataclass
class Targets:
    """What asked paths come to: files, directories to list, paths that are gone, and paths outside the roots."""

    files: list[str] = field(default_factory=list)
    directories: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    rejected: list[str] = field(default_factory=list)


def resolve_targets(roots: list[str], paths: list[str], settings: Settings | None = None) -> Targets:
    """Asked paths, absolute or relative to a root. More than max_targeted_paths are an error."""
    settings = settings or Settings()
    if len(paths) > settings.max_targeted_paths:
        raise ValueError(f"more than {settings.max_targeted_paths} paths")
    real, out = [os.path.realpath(r) for r in roots], Targets()
    for path in paths:
        options = [path] if os.path.isabs(path) else [os.path.join(r, path) for r in roots]
        inside = [p for p in map(os.path.realpath, options) if any(p == r or p.startswith(r + os.sep) for r in real)]
        there = next((p for p in inside if os.path.exists(p)), None)
        if not inside:
            out.rejected.append(path)
        elif there is None:
            out.missing.append(inside[0])
        else:
            (out.directories if os.path.isdir(there) else out.files).append(there)
    return out


def read_documents(spark: SparkSession, files: DataFrame, roots: list[str]) -> DataFrame:
    """(doc_id, root, path, title, text, content_hash, size_bytes, mtime_ns) of text files: binary ones are left out, bad UTF-8 is replaced, line ends are LF.

    Up to NAMED_FILES files are opened by name, so that an update reads what changed and nothing else; more are read with their roots and
    joined. PDF files are read by tessera.sources.pdf.
    """
    files = files.where(~F.lower("path").endswith(".pdf"))
    named = [r[0] for r in files.select("uri").limit(NAMED_FILES + 1).collect()]
    reader = spark.read.format("binaryFile")
    if not named:
        content = spark.createDataFrame([], "uri string, content binary")
    elif len(named) <= NAMED_FILES:
        content = reader.load([_escaped(u) for u in named]).select(F.col("path").alias("uri"), "content")
    else:
        content = reduce(DataFrame.unionByName, (reader.option("recursiveFileLookup", True).load(_root_uri(r)).select(F.col("path").alias("uri"), "content") for r in roots))
    rows = files.join(content, "uri").where(~is_binary(F.col("content")))
    text = normalized_lines(F.make_valid_utf8(F.col("content").cast("string")))
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(stable_id(F.col("root"), F.col("path")).alias("doc_id"), "root", "path", name.alias("title"), text.alias("text"), F.sha2("content", 256).alias("content_hash"), "size_bytes", "mtime_ns")


def scan_statistics(files: DataFrame, largest: int = 20) -> dict:
    """Counts and the largest files of a listing."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size_bytes"), F.lit(0))).first()
    top = files.orderBy(F.col("size_bytes").desc(), "path").limit(largest).select("size_bytes", "path").collect()
    return {"files": n, "bytes": size, "largest": [{"size": r[0], "path": r[1]} for r in top]}
