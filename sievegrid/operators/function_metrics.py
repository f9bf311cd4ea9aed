"""Functions of source files: lengths, nesting and branches, from token streams and indent trees.

Brackets of a script are matched and statements ended by windows over the tokens of one block, so no syntax tree is built.
Control statements and functions are intervals of tokens that lie in each other or apart: a running sum of their beginnings
and ends is the nesting at a place, and the innermost function of a place is the last one that began at its depth.
Python is read by indents: ``indent_tree`` gives each line the last line of what is indented under it.

Null texts have no functions; repeated keys are files that share their functions' rows, so keys should be unique. Not read
as a compiler would: nested template literals, decorators over several lines, and arrows without braces that no comma,
semicolon or bracket ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: bytes of text that a task cuts into tokens; each is some hundred bytes of rows to be sorted.
SHARE = 1 << 19

_NAME = r"[\p{L}_$#][\p{L}\p{N}_$]*"
_TOKENS = "|".join((
    r"/\*[\s\S]*?(?:\*/|$)", r"//[^\n]*", r'"(?>[^"\\\n]|\\[\s\S])*+"?', r"'(?>[^'\\\n]|\\[\s\S])*+'?", r"`(?>[^`\\]|\\[\s\S])*+`?",
    r"(?<=[(,=:\[!&|?{};\n]|return)[ \t]*/(?![*/])(?>[^/\\\[\n]|\\.|\[(?>[^\]\\\n]|\\.)*+\])++/[a-z]*", _NAME, r"=>", r"[{}()\[\];,:.=?*<>]", r"\n",
))
_BRANCHES = ("if", "for", "while", "do", "switch", "try", "catch")
#: Words before a parenthesis that don't name a method.
_NOT_METHODS = (*_BRANCHES, "with", "return", "function", "new", "typeof", "await", "super", "else", "case", "of", "in")


def _tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n (from 1), token, line, and its neighbours, without comments and line ends.

    Texts are dealt out by key before they are cut, in as many parts as their bytes ask for: tokens of a file lie together from
    here on, so windows and groups over them move nothing.
    """
    given = df.select(F.col(key).alias("file"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = F.transform(F.regexp_extract_all(F.regexp_replace("text", "\r\n", "\n"), F.lit(_TOKENS), F.lit(0)), lambda x: F.trim(x))
    rows = given.repartition(size // SHARE + 1, "file").select("file", F.posexplode(found).alias("n", "token"))
    rows = rows.withColumn("ends", F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit(""))) + (F.col("token") == "").cast("int"))
    order = Window.partitionBy("file").orderBy("n")
    rows = rows.withColumn("line", F.lit(1) + F.coalesce(F.sum("ends").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.where(~F.col("token").rlike(r"^(/\*|//|$)"))
    near = {f"b{i}": F.lag("token", i).over(order) for i in (1, 2, 3)} | {"a1": F.lead("token").over(order)}
    return rows.select("file", F.row_number().over(order).alias("n"), "token", (F.col("line") + F.col("ends")).cast("int").alias("line"), *(c.alias(k) for k, c in near.items()))


def _blocks(tokens: DataFrame) -> DataFrame:
    """Adds ``block`` (the bracket that a token stands in, 0 outside), ``match`` (the closing bracket of an opening one, and back),
    ``stop`` (where a statement without braces that begins here ends), ``reach`` (the same, with an ``else`` and the like that
    follows it), ``comma`` (n and line of where an expression ends), ``brace`` (the next one of the block: open, close and
    end_line), ``p1`` to ``p3`` (lines of the tokens before), ``next`` (what the next token has) and ``other`` (what the matching
    bracket has, with the token after it)."""
    opens, closes = F.col("token").isin("(", "[", "{"), F.col("token").isin(")", "]", "}")
    order = Window.partitionBy("file").orderBy("n")
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(order)
    level = tokens.withColumns({"level": (depth - opens.cast("int")).cast("int")} | {f"p{i}": F.lag("line", i).over(order) for i in (1, 2, 3)})  # brackets have the level of what they stand in
    # an opening bracket stands for itself too, one level deeper
    inside = level.withColumn("opener", F.explode(F.when(opens, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    inside = inside.withColumn("level", F.col("level") + F.col("opener").cast("int"))
    by_level = Window.partitionBy("file", "level").orderBy("n", F.desc("opener"))
    held = inside.withColumn("block", F.coalesce(F.last(F.when(F.col("opener"), F.col("n")), True).over(by_level), F.lit(0))).where(~F.col("opener")).drop("opener", "level")
    brackets = Window.partitionBy("file", "block", opens | closes).orderBy("n")
    down = Window.partitionBy("file", "block").orderBy(F.desc("n"))
    partner = lambda c: F.when(opens, F.lead(c).over(brackets)).when(closes, F.lag(c).over(brackets))
    stop = F.coalesce(F.last(F.when(F.col("token").isin(";", "}"), F.col("n")), True).over(down), F.first("n").over(down))
    goes_on = F.coalesce(F.col("a1").isin("else", "catch", "finally"), F.lit(False))
    reach = F.coalesce(F.last(F.when(F.col("token").isin(";", "}") & ~goes_on, F.col("n")), True).over(down), F.first("n").over(down))
    place = lambda n, line: F.struct(n.alias("n"), line.alias("line"))
    comma = F.coalesce(F.last(F.when(F.col("token").isin(";", ","), place(F.col("n") - 1, F.col("p1"))), True).over(down), F.first(place(F.col("n"), F.col("line"))).over(down))
    matched = held.withColumns({"match": partner("n"), "end_line": partner("line")})
    braces = F.struct(F.col("n").alias("open"), F.col("match").alias("close"), "end_line")
    brace = F.last(F.when(F.col("token") == "{", braces), True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    ended = matched.select("*", stop.alias("stop"), reach.alias("reach"), comma.alias("comma"), brace.alias("brace"))
    after = ended.withColumn("next", F.lead(F.struct("line", "match", "end_line", "stop", "reach", (F.col("token") == "{").alias("braced"))).over(order))
    return after.withColumn("other", partner(F.struct("n", "b1", "b2", "b3", "p1", "line", "a1", "stop", "brace", "next")))


def _nested(intervals: DataFrame) -> DataFrame:
    """Functions of each file with their deepest branch and number of branches; id 0 is what stands outside of them.

    intervals: file, n, end, kind (function or branch), weight, counts, name, start_line, end_line. Begins and ends are events in order.
    """
    order = Window.partitionBy("file").orderBy("n", "side", F.desc("begin"))
    told = F.when(F.col("kind") == "function", F.struct("name", "start_line", "end_line"))
    nothing = F.lit(None).cast("struct<name:string,start_line:int,end_line:int>")
    event = lambda n, side, begin, weight, id_, counts, shown: F.struct(n.alias("n"), F.lit(side).alias("side"), F.lit(begin).alias("begin"), weight.alias("weight"), id_.alias("id"), counts.alias("counts"), shown.alias("told"))
    begins = event(F.col("n"), 0, True, F.col("weight"), F.col("n"), F.col("counts"), F.when(F.col("end_line").isNotNull(), told))
    ends = event(F.col("end"), 1, False, -F.col("weight"), F.lit(None).cast("int"), F.lit(0), nothing)
    runs = intervals.select("file", "kind", F.explode(F.array(begins, ends)).alias("e")).select("file", "kind", "e.*")
    is_function = F.col("kind") == "function"
    runs = runs.withColumn("branches_open", F.sum(F.when(is_function, 0).otherwise(F.col("weight"))).over(order)).withColumn("depth", F.sum(F.when(is_function, F.col("weight")).otherwise(0)).over(order))
    by_depth = Window.partitionBy("file", "depth").orderBy("n", "side", F.desc("begin"))
    began = F.when(is_function & F.col("begin"), F.struct("id", "branches_open"))
    owned = runs.withColumn("owner", F.when(F.col("depth") > 0, F.last(began, True).over(by_depth)))
    own = (F.col("kind") == "branch") & F.col("begin")
    return owned.groupBy("file", F.coalesce("owner.id", F.lit(0)).alias("id")).agg(
        F.max(F.when(own, F.col("branches_open") - F.coalesce("owner.branches_open", F.lit(0))).otherwise(0)).cast("int").alias("nesting"), F.sum(F.when(own, F.col("counts")).otherwise(0)).cast("int").alias("branches"),
        F.max(F.when(is_function & F.col("begin") & (F.col("id") == F.col("owner.id")), F.col("told"))).alias("told"),
    )


def script_functions(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, start_line, end_line, length, nesting and branches of each function, method and arrow of a script.

    The row with a null name is what stands outside of functions; its length is null. Nesting counts the branches that are
    open inside the function itself: an ``else if`` is one deeper than its ``if``, and a ``catch`` one deeper than its ``try``.
    """
    t = _blocks(_tokens(df, key, text))
    order = Window.partitionBy("file").orderBy("n")
    is_ = lambda *words: F.col("token").isin(*words)

    # parentheses of parameters: of `function`, and of methods, whose body is the next brace of their block
    word = F.col("b1").rlike(rf"^{_NAME}$") & ~F.col("b1").isin(*_NOT_METHODS)
    declared = (F.col("b1") == "function") | (F.col("b2") == "function") | ((F.col("b1") == "*") & (F.col("b2") == "function")) | ((F.col("b2") == "*") & (F.col("b3") == "function"))
    after = F.col("other.a1")
    method = ~declared & (word | F.col("b1").rlike("^[\"']")) & ~F.coalesce(F.col("b2"), F.lit("")).isin(".", "new") & after.isin("{", ":")
    body = F.col("other.brace")
    begun = (body["open"] < F.col("other.stop")) & (declared | (after == ":") | (body["open"] == F.col("match") + 1))
    classic = F.coalesce(is_("(") & F.col("match").isNotNull() & (declared | method) & begun, F.lit(False))
    plain = F.regexp_replace("b1", "[\"']", "")
    bound = lambda sign, name: F.when((sign == "=") | (sign == ":"), F.when(name.rlike(rf"^{_NAME}$"), name))
    named = F.when(declared & F.col("b1").rlike(rf"^{_NAME}$") & (F.col("b1") != "function"), F.col("b1")).when(declared, bound(F.col("b2"), F.col("b3"))).otherwise(F.when(F.col("b2").isin("get", "set"), F.concat_ws(" ", "b2", plain)).otherwise(plain))
    back = F.when(declared, F.when(F.col("b1") == "function", 1).when(F.col("b3") == "function", 3).otherwise(2)).otherwise(1)

    # arrows: parameters to the left, a block or an expression to the right
    first = F.when(F.col("match").isNotNull(), F.struct(F.col("match").alias("n"), F.col("end_line").alias("line"), "other.p1", "other.b1", "other.b2", "other.b3")).otherwise(F.struct("n", "line", "p1", "b1", "b2", "b3"))
    left = F.col("left")
    arrow = F.coalesce(is_("=>") & left.isNotNull() & F.col("next").isNotNull(), F.lit(False))
    later = F.coalesce(left["b1"] == "async", F.lit(False))
    sign, name = F.when(later, left["b2"]).otherwise(left["b1"]), F.when(later, left["b3"]).otherwise(left["b2"])
    end = lambda n, line: F.struct(n.cast("int").alias("end"), line.alias("end_line"))
    stated = F.when(F.col("comma.n") > F.col("n"), end(F.col("comma.n"), F.col("comma.line"))).otherwise(end(F.col("n") + 1, F.col("next.line")))
    closed = F.when(F.col("a1") == "{", end(F.col("next.match"), F.col("next.end_line"))).otherwise(stated)

    # branches: a head, its parenthesis, then a block or a statement up to its stop
    member = F.coalesce(F.col("b1"), F.lit("")).isin(".") | F.coalesce(F.col("a1"), F.lit("")).isin(":", "=", ",", ".")
    skips = is_("for") & F.coalesce(F.col("a1") == "await", F.lit(False))
    asks = is_("if", "for", "while", "switch", "catch") & (F.coalesce(F.col("a1") == "(", F.lit(False)) | skips)
    paren = F.when(asks, F.when(skips, F.col("paren2")).otherwise(F.col("paren1")))
    head = ((is_(*_BRANCHES) & ~member) | (is_("else") & ~F.coalesce(F.col("a1") == "if", F.lit(False)) & F.col("a1").isNotNull())) & (~is_("if", "for", "while", "switch") | paren["n"].isNotNull())
    follows = F.when(paren["n"].isNotNull(), paren["next"]).otherwise(F.col("next"))
    over = F.coalesce(F.when(follows["braced"], follows["match"]), F.when(is_("for", "while"), follows["reach"]).otherwise(follows["stop"]), F.coalesce(paren["n"], F.col("n")) + 1)

    paired = F.struct("other.n", "other.next")
    seen = t.withColumns({"left": F.lag(first).over(order), "paren1": F.lead(paired, 1).over(order), "paren2": F.lead(paired, 2).over(order)})
    kind = F.when(classic | arrow, "function").when(head, "branch")
    seen = seen.withColumn("kind", kind).where(F.col("kind").isNotNull())
    begins = F.when(classic, F.struct((F.col("n") - back).alias("n"), F.when(back == 1, F.col("p1")).when(back == 2, F.col("p2")).otherwise(F.col("p3")).alias("line")))
    begins = begins.when(arrow, F.struct((left["n"] - later.cast("int")).alias("n"), F.when(later, left["p1"]).otherwise(left["line"]).alias("line"))).otherwise(F.struct("n", F.col("line").alias("line")))
    ends = F.when(classic, end(body["close"], body["end_line"])).when(arrow, closed).otherwise(end(over, F.lit(None).cast("int")))
    called = F.coalesce(F.when(classic, named).when(arrow, bound(sign, name)), F.lit("anonymous"))
    found = seen.select("file", "block", "token", "b1", "kind", begins.alias("begins"), ends.alias("ends"), called.alias("name"))

    # a chain of ifs is one island of its block; each `if` in it is one deeper
    chain = Window.partitionBy("file", "block").orderBy("begins.n")
    branch = F.col("kind") == "branch"
    is_if = (branch & (F.col("token") == "if")).cast("int")
    inner = F.coalesce(F.col("b1"), F.lit("")) == "else"
    found = found.withColumn("island", F.sum(F.when(inner, 0).otherwise(is_if)).over(chain))
    deep = F.sum(is_if).over(Window.partitionBy("file", "block", "island").orderBy("begins.n"))
    weight = F.when(branch & F.col("token").isin("if", "else"), deep).when(branch & (F.col("token") == "catch"), 2).otherwise(1)
    counts = (branch & (F.col("token") != "else")).cast("int")
    found = found.select("file", "kind", F.col("begins.n").cast("int").alias("n"), "begins.line", "ends", "name", weight.cast("int").alias("weight"), counts.alias("counts"))
    grouped = found.groupBy("file", "kind", "n").agg(F.max("ends").alias("ends"), F.max("name").alias("name"), F.max("line").alias("start_line"), F.max("weight").alias("weight"), F.max("counts").alias("counts"))
    return _reported(_nested(grouped.select("file", "kind", "n", "ends.end", "ends.end_line", "name", "start_line", "weight", "counts")), key)


def _reported(depth: DataFrame, key: str) -> DataFrame:
    shown = depth.where((F.col("id") == 0) | F.col("told.name").isNotNull()).select(F.col("file").alias(key), "told.*", "nesting", "branches")
    return shown.select(key, "name", "start_line", "end_line", (F.col("end_line") - F.col("start_line") + 1).alias("length"), "nesting", "branches")


def indent_tree(df: DataFrame, key: str, text: str, comment: str = "#") -> DataFrame:
    """key, line, indent, parent, last and content of each line that isn't blank or a comment.

    parent is the nearest line before with a smaller indent (0 where none); last is the last line that is indented under
    this one, or itself: the line before the next one of the same or a smaller indent.
    """
    schema = "file string, line int, indent int, parent int, last int, content string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[list] = []
                above: list[int] = []  # rows that are still open, by growing indent
                for number, raw in enumerate((whole or "").split("\n"), 1):
                    content = raw.strip()
                    if not content or content.startswith(comment):
                        continue
                    indent = len(raw) - len(raw.lstrip(" \t"))
                    while above and rows[above[-1]][1] >= indent:
                        rows[above.pop()][3] = rows[-1][0]
                    rows.append([number, indent, rows[above[-1]][0] if above else 0, number, content])
                    above.append(len(rows) - 1)
                for at in above:
                    rows[at][3] = rows[-1][0]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), *(pa.array([r[c] for r in rows], pa.int32()) for c in range(4)), pa.array([r[4] for r in rows], pa.string())], names=["file", "line", "indent", "parent", "last", "content"])

    return df.select(F.col(key).cast("string").alias("file"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("file", key)


def python_functions(df: DataFrame, key: str, text: str) -> DataFrame:
    """The same rows as ``script_functions`` for Python files, by indents."""
    tree = indent_tree(df, key, text).withColumnRenamed(key, "file")
    header = F.regexp_extract("content", r"^(?:async\s+)?def\s+([A-Za-z_]\w*)", 1)
    branch = F.col("content").rlike(r"^(?:async\s+)?(?:if|elif|else|for|while|with|try|except|finally|match|case)\b")
    kind = F.when(header != "", "function").when(branch, "branch")
    intervals = tree.select("file", F.col("line").alias("n"), F.col("last").alias("end"), kind.alias("kind"), F.lit(1).alias("weight"), F.lit(1).alias("counts"), header.alias("name"), F.col("line").alias("start_line"), F.col("last").alias("end_line"))
    return _reported(_nested(intervals.where(F.col("kind").isNotNull())), key)
