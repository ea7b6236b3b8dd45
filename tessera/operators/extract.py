"""Symbols, imports and references of source files, as DataFrame operations over arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import stable_id
from tessera.operators.navigation import enclosing

# Languages by file extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust", ".java": "java",
    ".kt": "kotlin", ".kts": "kotlin", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".cu": "cpp", ".cuh": "cpp", ".hpp": "cpp", ".hh": "cpp", ".cs": "c_sharp", ".rb": "ruby",
    ".php": "php", ".swift": "swift", ".scala": "scala", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".sql": "sql",
}
# What starts a definition on a line, and the groups that may hold its name.
DEFINITIONS = {
    "python": (r"^([ \t]*)(async\s+def|def|class)\s+([A-Za-z_][\w]*)", (3,)),
    "javascript": (r"^([ \t]*)(?:export\s+)?(?:async\s+)?(?:function|class)\s+([A-Za-z_$][\w$]*)", (2,)),
    "typescript": (r"^([ \t]*)(?:export\s+)?(?:async\s+)?(?:function|class|interface|type|enum)\s+([A-Za-z_$][\w$]*)", (2,)),
    "go": (r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_][\w]*)|^type\s+([A-Za-z_][\w]*)", (1, 2)),
    "rust": (r"^\s*(?:pub\s+)?(?:async\s+)?(?:fn|struct|enum|trait|impl)\s+([A-Za-z_][\w]*)?", (1,)),
    "java": (r"^\s*(?:public|private|protected|static|final|abstract|\s)+\s*(?:class|interface|enum)\s+([A-Za-z_][\w]*)|^\s*(?:public|private|protected|static|final|synchronized|async|\s)+[\w<>\[\], ?]+\s+([A-Za-z_][\w]*)\s*\(", (1, 2)),
    "cpp": (r"^\s*(?:class|struct|enum|namespace)\s+([A-Za-z_][\w]*)|^\s*[\w:<>~*&\s]+\s+([A-Za-z_~][\w:~]*)\s*\([^;]*\)\s*(?:const\s*)?(?:\{|$)", (1, 2)),
    "c": (r"^\s*(?:struct|enum)\s+([A-Za-z_][\w]*)|^\s*[\w_*\s]+\s+([A-Za-z_][\w]*)\s*\([^;]*\)\s*\{", (1, 2)),
}
#: The pattern of languages without one of their own.
OTHER = "typescript"
KINDS = ("class", "interface", "type", "enum", "struct", "trait", "impl")
# Imports over a whole text, with their groups.
IMPORTS = (
    (r"(?m)^\s*(?:from\s+([\w.]+)\s+)?import\s+([\w.*, {}]+)", (1, 2)),
    (r"""(?m)^\s*import\s+(?:type\s+)?(?:[\w*{},\s]+\s+from\s+)?['"]([^'"]+)['"]""", (1,)),
    (r"""(?m)^\s*export\s+.*\s+from\s+['"]([^'"]+)['"]""", (1,)),
    (r"(?m)^\s*use\s+([\w:]+)", (1,)),
    (r"""(?m)^\s*#include\s+[<"]([^>"]+)[>"]""", (1,)),
    (r"(?m)^\s*package\s+([\w.]+)", (1,)),
)
# Calls, and names that are none.
MEMBER_CALL = r"(?:[A-Za-z_$][\w$]*\.)+([A-Za-z_$][\w$]{1,80})\s*\("
CALL = r"(?<![.\w$])([A-Za-z_$][\w$]{1,80})\s*\("
NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "sizeof", "typeof", "println", "print", "assert", "dict", "list", "set", "tuple", "str", "int", "float", "bool", "len", "range")
NO_IMPORTS = ("import", "from", "as", "use", "package", "require", "export", "type")
DEFINITION_LINE = (
    r"^(?:async\s+)?def\s+|^(?:export\s+)?(?:async\s+)?function\s+|^func\s+|^(?:pub\s+)?(?:async\s+)?fn\s+|^(?:public|private|protected|static|final|abstract|\s)+[A-Za-z0-9_<>, ?\[\]]+\s+[A-Za-z_][\w]*\s*\("
)
IMPORT_LINE = r"^(?:import |from |use |#include|package |require\()| from .*(?:import|export)|(?:import|export).* from "


def language_of(path: Column) -> Column:
    """The language of a path by its extension, Dockerfiles by name; empty if there is none."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    by_extension = F.coalesce(F.try_element_at(table, F.regexp_extract(name, r"(\.[^.]+)$", 1)), F.lit(""))
    return F.when((name == "dockerfile") | F.endswith(name, F.lit(".dockerfile")), "dockerfile").otherwise(by_extension)


def lines_of(text: Column) -> Column:
    return F.split(text, "\r\n|\r|\n")


def imports_of(text: Column) -> Column:
    """The distinct imports of a text in order of their names, at most 256."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, groups in IMPORTS for g in groups))
    trimmed = F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: F.trim(x))
    return F.slice(F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x != ""))), 1, 256)


#: Files whose symbols and references one task sorts, about.
FILES = 20_000


def _tasks(files: DataFrame) -> int:
    """Tasks for what is sorted by file: as many as shuffles have, or more, so that a task has FILES at most; its memory then follows no table."""
    return max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-files.count() // FILES))


def _by_language(language: Column, f) -> Column:
    out = f(*DEFINITIONS[OTHER])
    for name, (pattern, groups) in DEFINITIONS.items():
        if name != OTHER:
            out = F.when(language == name, f(pattern, groups)).otherwise(out)
    return out


def kind_of(head: Column) -> Column:
    """The first kind whose word is part of the head, else function."""
    out = F.lit("function")
    for word in reversed(KINDS):
        out = F.when(F.lower(head).contains(word), word).otherwise(out)
    return out


def signature_of(lines: Column) -> Column:
    """The first lines of a symbol up to the one that opens its body (or 260 characters), without the body."""
    head = F.filter(F.transform(F.slice(lines, 1, 8), lambda x: F.trim(x)), lambda x: x != "")
    joined = F.aggregate(
        head,
        F.struct(F.lit("").alias("text"), F.lit(False).alias("done")),
        lambda s, x: F.when(s["done"], s).otherwise(
            F.struct(
                F.trim(F.concat_ws(" ", s["text"], x)).alias("text"),
                (x.contains("{") | F.endswith(x, F.lit(":")) | (F.length(s["text"]) + F.length(x) + 1 > 260)).alias("done"),
            )
        ),
        lambda s: s["text"],
    )
    return F.substring(F.rtrim(F.regexp_extract(joined, r"^([^{]*)", 1)), 1, 500)


def docstring_of(lines: Column) -> Column:
    """The comment or string right below a definition: a quoted first line, or the comment lines up to the first other one."""
    below = F.filter(F.transform(F.slice(lines, 2, 11), lambda x: F.trim(x)), lambda x: x != "")
    first = F.coalesce(F.get(below, F.lit(0)), F.lit(""))
    quoted = F.regexp_replace(first, r"^[\"' ]+|[\"' ]+$", "")
    comment = lambda x: x.rlike(r"^(?:#|//|/?\*)")
    plain = F.aggregate(
        below,
        F.struct(F.lit("").alias("text"), F.lit(False).alias("done")),
        lambda s, x: F.when(s["done"] | ~comment(x), F.struct(s["text"].alias("text"), F.lit(True).alias("done"))).otherwise(
            F.struct(F.concat_ws("\n", F.when(s["text"] != "", s["text"]), F.regexp_replace(x, r"^[#/ *]+|[*/ ]+$", "")).alias("text"), x.contains("*/").alias("done"))
        ),
        lambda s: s["text"],
    )
    return F.substring(F.when(first.rlike("^(?:\"\"\"|''')"), quoted).otherwise(plain), 1, 800)


def symbols(files: DataFrame) -> DataFrame:
    """(id, doc_id, path, language, kind, name, qualified_name, parent, signature, docstring, text, line_start, line_end) of files (doc_id, path, text).

    A definition is found on its line, and ends where the next begins. It stands in the nearest class or the like before it that is indented less and that no line
    in between (comments aside) ends by being indented no more than it; parent names these from the outside in. Files are shuffled by doc_id, few to a task. The id counts equal definitions
    of a file and knows no lines, so edits elsewhere in the file keep it.
    """
    rows = files.select("doc_id", "path", language_of(F.col("path")).alias("language"), lines_of(F.coalesce("text", F.lit(""))).alias("lines")).where("language not in ('', 'dockerfile')")

    def definition(line: Column, i: Column) -> Column:
        head = _by_language(F.col("language"), lambda p, _: F.regexp_extract(line, p, 0))
        name = _by_language(F.col("language"), lambda p, groups: F.coalesce(*(F.nullif(F.trim(F.regexp_extract(line, p, g)), F.lit("")) for g in groups)))
        return F.struct(i.alias("at"), head.alias("head"), F.coalesce(name, F.when(head.contains("impl"), F.concat(F.lit("impl@"), i + 1))).alias("name"), indent(line).alias("indent"))

    def indent(line: Column) -> Column:
        return F.length(F.regexp_extract(line, r"^[ \t]*", 0))

    def nested(state: Column, d: Column) -> Column:
        """Goes over the definitions with those that are open, each with its full name."""
        between = F.filter(F.slice("lines", state["next"] + 1, d["at"] - state["next"]), lambda x: ~x.rlike(r"^\s*(?:$|#|//|\*|@)"))
        low = F.least(d["indent"], F.coalesce(F.array_min(F.transform(between, indent)), d["indent"]))
        open_ = F.filter(state["open"], lambda s: s["indent"] < low)
        parent = F.coalesce(F.get(open_, F.size(open_) - 1)["name"], F.lit(""))
        full = F.concat_ws(".", F.nullif(parent, F.lit("")), d["name"])
        return F.struct(
            (d["at"] + 1).alias("next"), F.when(kind_of(d["head"]) == "function", open_).otherwise(F.array_append(open_, F.struct(d["indent"].alias("indent"), full.alias("name")))).alias("open"),
            F.array_append(state["done"], F.struct(parent.alias("parent"), full.alias("qualified_name"))).alias("done"),
        )

    rows = rows.withColumn("defs", F.filter(F.transform("lines", definition), lambda d: (d["head"] != "") & d["name"].isNotNull()))
    start = F.expr("struct(0 as next, cast(array() as array<struct<indent: int, name: string>>) as open, cast(array() as array<struct<parent: string, qualified_name: string>>) as done)")
    rows = rows.withColumn("scopes", F.aggregate("defs", start, nested, lambda s: s["done"]))
    each = rows.select("doc_id", "path", "language", "lines", "defs", "scopes", F.posexplode(F.transform("defs", lambda d: d["at"])).alias("k", "at"))
    each = each.withColumn("scope", F.get("scopes", F.col("k"))).withColumn("d", F.get("defs", F.col("k"))).withColumn("stop", F.coalesce(F.get("defs", F.col("k") + 1)["at"], F.size("lines")))
    each = each.withColumn("own", F.slice("lines", F.col("at") + 1, F.col("stop") - F.col("at")))
    each = each.select(
        "doc_id", "path", "language", kind_of(F.col("d.head")).alias("kind"), F.col("d.name").alias("name"), "scope.qualified_name", "scope.parent",
        signature_of(F.col("own")).alias("signature"), docstring_of(F.col("own")).alias("docstring"), F.trim(F.array_join("own", "\n")).alias("text"), (F.col("at") + 1).alias("line_start"), F.col("stop").alias("line_end"), "k",
    )
    from pyspark.sql import Window

    each = each.repartition(_tasks(files), "doc_id")
    w = Window.partitionBy("doc_id", "kind", "qualified_name", "signature").orderBy("k")
    each = each.withColumn("occurrence", F.row_number().over(w) - 1)
    return each.select(stable_id("symbol-v2", F.col("doc_id"), F.col("language"), F.col("kind"), F.col("qualified_name"), F.col("signature"), F.col("occurrence"), length=28).alias("id"), *[c for c in each.columns if c not in ("k", "occurrence")])


def references(files: DataFrame, found: DataFrame) -> DataFrame:
    """(id, doc_id, path, language, source_symbol_id, target_name, target_name_lc, ref_kind, line, snippet) of files, found being their symbols.

    Calls and imports, each name once a line and kind; comments and definition lines have no calls. The source is the innermost symbol around the line.
    """
    rows = files.select("doc_id", "path", language_of(F.col("path")).alias("language"), F.posexplode(lines_of(F.coalesce("text", F.lit("")))).alias("n", "raw")).where("language not in ('', 'dockerfile')")
    rows = rows.select("doc_id", "path", "language", (F.col("n") + 1).alias("line"), "raw", F.trim("raw").alias("own")).where("own <> '' and not (startswith(own, '#') or startswith(own, '//') or startswith(own, '*'))")
    names = F.regexp_extract_all("own", F.lit(r"([A-Za-z_$][\w$]*)(?=\s*(?:,|\}|$|\sas\s))"), F.lit(1))
    tails = F.transform(F.regexp_extract_all("own", F.lit(r"""['"]([^'"]+)['"]"""), F.lit(1)), lambda q: F.regexp_extract(q, r"([^/.]*)[^/]*/*$", 1))
    imported = F.slice(F.filter(F.concat(names, tails), lambda x: ~x.isin(*NO_IMPORTS) & (x != "")), 1, 64)
    called = F.filter(F.concat(F.regexp_extract_all("raw", F.lit(MEMBER_CALL), F.lit(1)), F.regexp_extract_all("raw", F.lit(CALL), F.lit(1))), lambda x: ~x.isin(*NO_CALLS, "require", "import"))
    none = F.slice(F.array(F.lit("")), 1, 0)
    imports = F.when(F.col("own").rlike(IMPORT_LINE), imported).otherwise(none)
    calls = F.when(F.col("own").rlike(DEFINITION_LINE), none).otherwise(called)
    struct = lambda kind: lambda x: F.struct(x.alias("target_name"), F.lit(kind).alias("ref_kind"))
    each = rows.withColumn("x", F.explode(F.array_distinct(F.concat(F.transform(imports, struct("import")), F.transform(calls, struct("call"))))))
    each = each.select("doc_id", "path", "language", "line", "x.target_name", "x.ref_kind", F.substring("own", 1, 240).alias("snippet"))
    each = enclosing(each, found, "doc_id", parts=_tasks(files)).withColumn("source_symbol_id", F.coalesce("enclosing_id", F.lit("")))
    key = stable_id(F.col("doc_id"), F.col("source_symbol_id"), F.col("target_name"), F.col("ref_kind"), F.col("line"), F.col("snippet"), length=28)
    return each.select(key.alias("id"), "doc_id", "path", "language", "source_symbol_id", "target_name", F.lower("target_name").alias("target_name_lc"), "ref_kind", "line", "snippet")
