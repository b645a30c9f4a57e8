"""Records of Rust and C source files, found by patterns and brace matching (EXT-*).

Input: files (repo, path, content).  A pattern's matches cut the file; each match is then followed
to its end by a fold over the file's braces only, not over its characters.  ``compat`` gives the
plain patterns' quirks; the default gives what they mean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T

#: The declaration patterns.
RUST_FN = r"(?mdU)^(\s*)(pub(?:\([^)]+\))?\s+)?fn\s+(\w+)\s*(<[^>]+>)?\s*\(([^)]*)\)(\s*->\s*[^{]+)?\s*\{"
RUST_STRUCT = r"(?mdU)^(\s*)(pub(?:\([^)]+\))?\s+)?struct\s+(\w+)"
RUST_ENUM = r"(?mdU)^(\s*)(pub(?:\([^)]+\))?\s+)?enum\s+(\w+)"
RUST_CONST = r"(?mdU)^(\s*)(pub(?:\([^)]+\))?\s+)?const\s+(\w+)\s*:\s*([^=]+)\s*=\s*([^;]+);"
RUST_IMPL = r"(?mdU)^(\s*)((?:unsafe\s+)?)impl(?:\s*<[^>{]*>)?\s+([\w:]+(?:<[^{]*?>)?)[^{;]*\{"
C_FN = r"(?mdU)^(\w+(?:\s*\*)?)\s+(\w+)\s*\(([^)]*)\)\s*\{"
C_STRUCT = r"(?mdU)^(?:typedef\s+)?struct\s+(\w+)\s*\{"
C_ENUM = r"(?mdU)^(?:typedef\s+)?enum\s+(\w+)\s*\{"
C_TYPEDEF = r"(?mdU)^typedef\s+[^;{}]*?(\w+)\s*;"
C_ANONYMOUS = r"(?mdU)^typedef\s+(?:struct|union|enum)\s*(?:\w+\s*)?\{"
C_DEFINE = r"(?dU)^#define\s+(\w+)\s+(.+)$"
_CONTROL = ["if", "while", "for", "switch"]


def _found(files: DataFrame, pattern: str, more=None) -> DataFrame:
    """A row for each match: repo, path, line, match, the part before, and with ``more`` the body.

    ``more(near, tail)``: the characters of the body after the match, from the part up to the next match or,
    if that has no end, the rest of the file.  Bodies are cut while the file is one row, so that no match
    carries a copy of it.  Files are dealt to a set number of tasks, which adaptive execution does not make
    fewer for their few bytes; matches, which are short, are dealt again, so that what is made of them
    (comments, signatures) does not wait for the task that has the longest file.
    """
    content = F.col("content")
    dealt = files.select("repo", "path", "content").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "repo", "path")

    def row(p: Column) -> Column:
        def cut(match: Column) -> Column:
            plain = [p["line"].alias("line"), p["before"].alias("before"), match.alias("match")]
            if more is None:
                return F.struct(*plain)
            near = F.substring(p["text"], F.length(match) + 1, F.length(p["text"]))
            tail = F.substring(content, p["start"] + F.length(match), F.length(content))
            # a cut of the part where that is enough, for a cut of the file is a walk to its place
            body = lambda n: F.when(n <= F.length(p["text"]), F.substring(p["text"], F.lit(1), n)).otherwise(F.substring(content, p["start"], n))
            return F.struct(*plain, T.let(F.length(match) + more(near, tail), body).alias("body"))

        return T.let(F.regexp_extract(p["text"], pattern, 0), cut)

    # the outer form, for Spark would filter by the size of the other's array and make it twice
    rows = F.transform(F.slice(T.pieces(content, pattern), F.lit(2), F.lit(1 << 30)), row)
    found = dealt.select("repo", "path", F.explode_outer(rows).alias("__p")).filter("__p IS NOT NULL").select("repo", "path", "__p.*")
    return found.repartition("repo", "path", "line")


def _end(marks: str, start: int, step):
    """Characters after the match up to and with the mark at which ``step(depth, mark) -> (depth, done)`` is done.

    The part up to the next match mostly has it; else the rest of the file is read, all of it if no
    mark is the end.
    """
    zero = F.struct(F.lit(start).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def fold(a: Column, s: Column) -> Column:
        depth, done = step(a["depth"], F.right(s, F.lit(1)))
        return F.when(a["done"], a).otherwise(F.struct(depth.alias("depth"), (a["n"] + F.length(s)).alias("n"), done.alias("done")))

    def over(tail: Column, missing: Column) -> Column:
        # \G: where no mark is left, the search ends and doesn't start again at every character
        return F.aggregate(F.regexp_extract_all(tail, F.lit(f"(?s)\\G[^{marks}]*+[{marks}]"), F.lit(0)), zero, fold, lambda a: F.when(a["done"], a["n"]).otherwise(missing))

    return lambda near, tail: F.coalesce(over(near, F.lit(None).cast("int")), T.let(tail, lambda t: over(t, F.length(t))))


def _braced(depth: Column, mark: Column) -> tuple[Column, Column]:
    after = depth + F.when(mark == "{", 1).otherwise(-1)
    return after, after == 0


def _struct_compat(depth: Column, mark: Column) -> tuple[Column, Column]:
    after = depth + F.when(mark == "{", 1).when((mark == "}") & (depth > 0), -1).otherwise(0)
    return after, (depth == 0) & mark.isin("}", ";")


def _struct(depth: Column, mark: Column) -> tuple[Column, Column]:
    after = depth + F.when(mark.isin("{", "(", "["), 1).when(mark.isin("}", ")", "]"), -1).otherwise(0)
    return after, ((mark == ";") & (depth == 0)) | ((mark == "}") & (after <= 0))


def _enum(depth: Column, mark: Column) -> tuple[Column, Column]:
    return depth + F.when(mark == "{", 1).otherwise(-1), (mark == "}") & (depth == 1)


def _above() -> Column:
    """The lines above a match, nearest first.  Those before the last match can't count: it ends any walk."""
    lines = F.split("before", "\n")
    return F.reverse(F.slice(lines, F.lit(1), F.size(lines) - 1))


def _walk(keep, skip) -> Column:
    """The comment lines above a match, walking up: kept ones cut, skipped ones passed, any other ends it (EXT-06, EXT-24)."""
    above = _above()
    zero = F.struct(F.lit(False).alias("stop"), F.array().cast("array<string>").alias("docs"))

    def fold(a: Column, raw: Column) -> Column:
        def seen(line: Column) -> Column:
            kept = F.struct(F.lit(False).alias("stop"), F.array_prepend(a["docs"], keep(line)).alias("docs"))
            return F.when(a["stop"], a).when(keep(line).isNotNull(), kept).when(skip(line), a).otherwise(F.struct(F.lit(True).alias("stop"), a["docs"].alias("docs")))

        return T.let(T.strip(raw), seen)

    docs = F.aggregate(above, zero, fold, lambda a: a["docs"])
    return F.when(F.size(docs) > 0, F.array_join(docs, "\n"))


def _rust_doc() -> Column:
    keep = lambda x: F.when(x.startswith("///") | x.startswith("//!"), T.strip(F.substring(x, F.lit(4), F.length(x))))
    return _walk(keep, lambda x: (x == "") | x.startswith("#["))


def _c_doc(blocks: bool) -> Column:
    """The comment above a C declaration: ``//`` lines, and the block that ends the walk if ``blocks`` (EXT-23, EXT-24).

    Of a block count all lines from its first, without the marks; blank lines are passed.
    """
    if not blocks:
        return _walk(lambda x: F.when(x.startswith("//"), T.strip(F.substring(x, F.lit(3), F.length(x)))), lambda x: x == "")
    # 0: lines above a declaration, 1: inside a block, 2: done
    zero = F.struct(F.lit(0).alias("state"), F.array().cast("array<string>").alias("docs"))
    put = lambda a, state, doc: F.struct(F.lit(state).alias("state"), F.array_prepend(a["docs"], doc).alias("docs"))
    end = lambda a: F.struct(F.lit(2).alias("state"), a["docs"].alias("docs"))

    def fold(a: Column, raw: Column) -> Column:
        def seen(x: Column) -> Column:
            opening = T.strip(F.regexp_replace(x, r"^[/*]+", ""))
            inside = F.when(x.contains("/*"), F.when(opening != "", put(a, 2, opening)).otherwise(end(a))).otherwise(put(a, 1, T.strip(F.regexp_replace(x, r"^\*+", ""))))
            closing = T.strip(F.regexp_replace(x, r"[*/]+$", ""))
            alone = T.strip(F.regexp_replace(closing, r"^/\*+", ""))
            above = (
                F.when(x.startswith("//"), put(a, 0, T.strip(F.substring(x, F.lit(3), F.length(x)))))
                .when(x.endswith("*/") & x.startswith("/*"), F.when(alone != "", put(a, 2, alone)).otherwise(end(a)))
                .when(x.endswith("*/") & ~x.contains("/*"), put(a, 1, T.strip(F.regexp_replace(closing, r"^\*+", ""))))
                .when(x == "", a)
                .otherwise(end(a))
            )
            return F.when(a["state"] == 2, a).when(a["state"] == 1, inside).otherwise(above)

        return T.let(T.strip(raw), seen)

    docs = F.aggregate(_above(), zero, fold, lambda a: a["docs"])
    joined = T.strip(F.array_join(docs, "\n"), "\n")
    return F.when(joined != "", joined)


def _attributes() -> Column:
    """The one-line attributes above a declaration, in their order (EXT-07)."""
    above = _above()
    zero = F.struct(F.lit(False).alias("stop"), F.array().cast("array<string>").alias("got"))

    def fold(a: Column, raw: Column) -> Column:
        def seen(line: Column) -> Column:
            got = F.struct(F.lit(False).alias("stop"), F.array_prepend(a["got"], line).alias("got"))
            passed = (line == "") | line.startswith("///") | line.startswith("//!")
            return F.when(a["stop"], a).when(line.startswith("#["), got).when(passed, a).otherwise(F.struct(F.lit(True).alias("stop"), a["got"].alias("got")))

        return T.let(T.strip(raw), seen)

    return F.aggregate(above, zero, fold, lambda a: a["got"])


def visibility(raw: Column) -> Column:
    """pub, pub(crate), the text itself, or private (EXT-08)."""
    plain = T.strip(raw)
    return F.when(plain == "", "private").when(plain == "pub", "pub").when(plain.contains("crate"), "pub(crate)").otherwise(plain)


def _items(found: DataFrame, kind: str, name: Column, signature: Column, doc: Column, seen: Column, attributes: Column) -> DataFrame:
    return found.select("repo", F.col("path").alias("file_path"), F.lit(kind).alias("kind"), name.alias("name"), signature.alias("signature"), "body", doc.alias("doc_comment"), F.col("line").cast("int").alias("line_number"), seen.alias("visibility"), attributes.alias("attributes"))


def rust(files: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(items, constants) of Rust files: public functions, structs and enums, constants of any visibility, and impls.

    ``compat``: structs run to the next semicolon at depth 0, no attributes and no impls; visibility is
    the text itself and constants are public ones only.
    """
    group = lambda p, n: F.regexp_extract("match", p, n)
    none = F.array().cast("array<string>")
    attributes = none if compat else _attributes()
    public = lambda p: T.strip(group(p, 2)).startswith("pub")
    seen = lambda p: T.strip(group(p, 2)) if compat else visibility(group(p, 2))
    parts = []
    functions = _found(files, RUST_FN, _end(r"{}", 1, _braced)).filter(public(RUST_FN))
    signature = T.strip(F.concat(F.lit("fn "), group(RUST_FN, 3), F.lit("("), group(RUST_FN, 5), F.lit(")"), group(RUST_FN, 6)))
    parts.append(_items(functions, "function", group(RUST_FN, 3), signature, _rust_doc(), seen(RUST_FN), attributes))
    end = _end(r"{};", 0, _struct_compat) if compat else _end(r"{}()\[\];", 0, _struct)
    structs = _found(files, RUST_STRUCT, end).filter(public(RUST_STRUCT))
    parts.append(_items(structs, "struct", group(RUST_STRUCT, 3), F.concat(F.lit("struct "), group(RUST_STRUCT, 3)), _rust_doc(), seen(RUST_STRUCT), attributes))
    enums = _found(files, RUST_ENUM, _end(r"{}", 0, _enum)).filter(public(RUST_ENUM))
    parts.append(_items(enums, "enum", group(RUST_ENUM, 3), F.concat(F.lit("enum "), group(RUST_ENUM, 3)), _rust_doc(), seen(RUST_ENUM), attributes))
    if not compat:
        impls = _found(files, RUST_IMPL, _end(r"{}", 1, _braced))
        name = F.concat(F.lit("impl "), group(RUST_IMPL, 3))
        parts.append(_items(impls, "impl", name, name, F.lit(None).cast("string"), F.lit("pub"), attributes))
    constants = _found(files, RUST_CONST)
    if compat:
        constants = constants.filter(public(RUST_CONST))
    consts = constants.select("repo", F.col("path").alias("file_path"), group(RUST_CONST, 3).alias("name"), T.strip(group(RUST_CONST, 5)).alias("value"), T.strip(group(RUST_CONST, 4)).alias("type_annotation"), _rust_doc().alias("doc_comment"), F.col("line").cast("int").alias("line_number"))
    return reduce(DataFrame.unionByName, parts), consts


def c(files: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(items, constants) of C files: functions, structs and defines; without ``compat`` also enums and typedefs."""
    group = lambda p, n: F.regexp_extract("match", p, n)
    none, pub = F.array().cast("array<string>"), F.lit("pub")
    functions = _found(files, C_FN, _end(r"{}", 1, _braced)).filter(~group(C_FN, 2).isin(_CONTROL))
    signature = F.concat(T.strip(group(C_FN, 1)), F.lit(" "), group(C_FN, 2), F.lit("("), group(C_FN, 3), F.lit(")"))
    parts = [_items(functions, "function", group(C_FN, 2), signature, _c_doc(not compat), pub, none)]

    def closed(near: Column, tail: Column) -> Column:
        """To the closing brace, then to the next semicolon or the end."""
        semicolon = lambda text, n: F.call_function("instr", F.substring(text, n + 1, F.length(text)), F.lit(";"))
        far = lambda n: T.let(tail, lambda t: T.let(semicolon(t, n), lambda k: F.when(k > 0, n + k).otherwise(F.length(t))))
        return T.let(_end(r"{}", 1, _braced)(near, tail), lambda n: T.let(semicolon(near, n), lambda k: F.when(k > 0, n + k).otherwise(far(n))))

    for kind, pattern in (("struct", C_STRUCT), *([] if compat else [("enum", C_ENUM)])):
        parts.append(_items(_found(files, pattern, closed), kind, group(pattern, 1), F.concat(F.lit(f"{kind} "), group(pattern, 1)), _c_doc(not compat), pub, none))
    if not compat:
        types = _found(files, C_TYPEDEF, lambda near, tail: F.lit(0))
        parts.append(_items(types, "type", group(C_TYPEDEF, 1), F.concat(F.lit("typedef "), group(C_TYPEDEF, 1)), _c_doc(True), pub, none))
        # typedef struct {..} NAME; its name comes after the braces
        bodies = _items(_found(files, C_ANONYMOUS, closed), "type", F.lit(""), F.lit(""), _c_doc(True), pub, none)
        name = F.regexp_extract("body", r"(?s)(\w+)\s*(?:\[[^\]]*\]\s*)*;$", 1)
        parts.append(bodies.withColumns({"name": name, "signature": F.concat(F.lit("typedef "), name)}).filter("name <> ''"))
    return reduce(DataFrame.unionByName, parts), defines(files)


def defines(files: DataFrame) -> DataFrame:
    """``#define NAME value`` lines with the comment before them (EXT-21, EXT-22).

    The comment is the line before if it starts with ``//``, or the block that ends there: its lines
    after the opening one.  Function-like and empty macros are no constants.
    """
    lines = files.select("repo", "path", F.split("content", "\n").alias("__lines"))
    each = lines.select("repo", "path", "__lines", F.posexplode("__lines").alias("__i", "__raw")).withColumn("__line", T.strip(F.col("__raw")))
    found = each.filter(F.col("__line").rlike(C_DEFINE)).withColumns({"name": F.regexp_extract("__line", C_DEFINE, 1), "value": T.strip(F.regexp_extract("__line", C_DEFINE, 2))})
    before = T.strip(F.get("__lines", F.col("__i") - 1))
    zero = F.struct(F.lit(False).alias("stop"), F.array().cast("array<string>").alias("got"))
    fold = lambda a, x: F.when(a["stop"], a).when(x.contains("/*"), F.struct(F.lit(True).alias("stop"), a["got"].alias("got"))).otherwise(F.struct(F.lit(False).alias("stop"), F.array_prepend(a["got"], T.strip(F.regexp_replace(T.strip(x), r"^\*+", ""))).alias("got")))
    block = F.aggregate(F.reverse(F.slice("__lines", F.lit(1), F.col("__i"))), zero, fold, lambda a: F.when(F.size(a["got"]) > 0, F.array_join(a["got"], "\n")))
    doc = F.when(F.col("__i") == 0, None).when(before.startswith("//"), T.strip(F.substring(before, F.lit(3), F.length(before)))).when(before.endswith("*/"), block)
    return found.select("repo", F.col("path").alias("file_path"), "name", "value", F.lit(None).cast("string").alias("type_annotation"), doc.alias("doc_comment"), (F.col("__i") + 1).cast("int").alias("line_number"))


def statistics(items: DataFrame, constants: DataFrame, files: DataFrame) -> DataFrame:
    """Files, items, constants and items of each kind by repo (PRJ-19, AGG-02, AGG-03)."""
    kinds = ["function", "struct", "enum", "impl", "type"]
    counted = items.groupBy("repo").agg(F.count(F.lit(1)).alias("items"), *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in kinds])
    consts = constants.groupBy("repo").agg(F.count(F.lit(1)).alias("constants"))
    seen = files.groupBy("repo").agg(F.count(F.lit(1)).alias("files_processed"))
    out = seen.join(counted, "repo", "left").join(consts, "repo", "left")
    return out.na.fill(0)


def name_index(items: DataFrame, constants: DataFrame) -> DataFrame:
    """(category, name) -> the place of its last record in (path, line) order (SNK-02, AGG-08)."""
    named = items.select("repo", F.concat("kind", F.lit("s")).alias("category"), "name", F.col("file_path").alias("file"), F.col("line_number").alias("line"), F.lit(None).cast("string").alias("value"))
    named = named.unionByName(constants.select("repo", F.lit("constants").alias("category"), "name", F.col("file_path").alias("file"), F.col("line_number").alias("line"), "value"))
    last = F.max(F.struct("file", "line", "value")).alias("x")
    return named.groupBy("repo", "category", "name").agg(last).select("repo", "category", "name", "x.file", "x.line", "x.value")


