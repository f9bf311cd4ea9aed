"""Python imports as they are written over several lines, and the files that they mean.

Logical lines come from a token stream: brackets that are open and backslashes carry a line on, strings and comments are
tokens of their own. Modules are looked up as keys: each import gives its candidate paths, one for each root and name,
and those are joined with the paths of modules, so no tree is walked.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TOKENS = "|".join((
    r'"""[\s\S]*?(?:"""|$)', r"'''[\s\S]*?(?:'''|$)", r'"(?>[^"\\\n]|\\[\s\S])*+"?', r"'(?>[^'\\\n]|\\[\s\S])*+'?", r"#[^\n]*", r"\\\r?\n", r"\n", r"[(){}\[\],;*]", r"\.+(?!\w)|\.*[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*",
))
#: Modules that were removed from the standard library.
LEGACY = (
    "aifc", "asynchat", "asyncore", "audioop", "binhex", "cgi", "cgitb", "chunk", "crypt", "distutils", "formatter", "imghdr", "imp", "mailcap", "msilib", "nis", "nntplib", "ossaudiodev",
    "parser", "pipes", "smtpd", "sndhdr", "spwd", "sunau", "symbol", "telnetlib", "uu", "xdrlib",
)
#: Modules whose distribution has another name.
DISTRIBUTIONS = {
    "yaml": "pyyaml", "PIL": "pillow", "cv2": "opencv-python", "sklearn": "scikit-learn", "bs4": "beautifulsoup4", "dotenv": "python-dotenv", "jwt": "pyjwt", "dateutil": "python-dateutil",
    "OpenSSL": "pyopenssl", "Crypto": "pycryptodome", "_pytest": "pytest", "attr": "attrs", "MySQLdb": "mysqlclient", "psycopg2": "psycopg2-binary", "magic": "python-magic",
}


def statements(files: DataFrame) -> DataFrame:
    """path, line, level, module and names of each import: a row for each module of ``import``, and one for each ``from``.

    files: path, text. level is the number of leading dots; a star is no name; null texts have none.
    """
    found = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(_TOKENS), F.lit(0))
    rows = files.select("path", F.posexplode(found).alias("n", "token"))
    order = Window.partitionBy("path").orderBy("n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    depth = F.sum(F.when(F.col("token").isin("(", "[", "{"), 1).when(F.col("token").isin(")", "]", "}"), -1).otherwise(0)).over(order)
    rows = rows.withColumns({"line": (F.coalesce(F.sum(ends).over(before), F.lit(0)) + 1).cast("int"), "depth": depth})
    rows = rows.withColumn("breaks", ((F.col("depth") <= 0) & F.col("token").isin("\n", ";")).cast("int"))
    rows = rows.withColumn("statement", F.coalesce(F.sum("breaks").over(before), F.lit(0))).where(~F.col("token").rlike(r"^(#|\\|\n|;)"))
    lead = F.first("token").over(Window.partitionBy("path", "statement").orderBy("n"))
    kept = rows.withColumn("lead", lead).where(F.col("lead").isin("from", "import"))
    whole = kept.groupBy("path", "statement", "lead").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t")).withColumn("t", F.transform("t", lambda x: x["token"]))
    listed = lambda tokens: F.filter(F.transform(F.split(F.array_join(F.filter(tokens, lambda x: ~x.isin("(", ")")), " "), " ?, ?"), lambda p: F.split(F.trim(p), " ")[0]), lambda x: x.rlike(r"^\w"))
    at = F.array_position("t", "import").cast("int")
    plain = whole.where("lead = 'import'").select("path", "line", F.lit(0).alias("level"), F.explode(listed(F.slice("t", F.lit(2), F.size("t")))).alias("module"), F.array().cast("array<string>").alias("names"))
    source = F.array_join(F.slice("t", F.lit(2), at - 2), "")
    froms = whole.where((F.col("lead") == "from") & (at > 2)).select("path", "line", F.length(F.regexp_extract(source, r"^\.*", 0)).alias("level"), F.regexp_replace(source, r"^\.+", "").alias("module"), listed(F.slice("t", at + 1, F.size("t"))).alias("names"))
    return plain.unionByName(froms)


def roots(paths: DataFrame) -> DataFrame:
    """root and place: where absolute imports may start. The tree itself, ``src``, folders with a project file, and their ``src``; those with modules."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    projects = paths.where(F.substring_index("path", "/", -1).isin("pyproject.toml", "setup.py", "setup.cfg")).select(folder.alias("root")).distinct()
    under = F.concat_ws("/", F.nullif(F.col("root"), F.lit("")), F.lit("src"))
    sources = paths.where(F.col("path").rlike(r"(^|/)src/.*\.py$")).select(F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/")), lambda p: p.rlike("(^|/)src$"))).alias("root")).distinct()
    made = paths.sparkSession.range(1).select(F.lit("").alias("root"), F.lit(0).alias("kind"))
    made = made.union(sources.where("root = 'src'").select("root", F.lit(1))).union(projects.select("root", F.lit(2))).union(projects.select(under.alias("root")).join(sources, "root", "left_semi").select("root", F.lit(2)))
    first = made.groupBy("root").agg(F.min("kind").alias("kind"))
    return first.select("root", F.row_number().over(Window.orderBy("kind", "root")).alias("place"))  # a row for each project of a tree


def resolved(files: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """path, line, spec, kind (local, builtin, package or unresolved), target and package of each import of a tree's Python files.

    files: path, text (other files may be there too, with null text). The first root under which the module or one of the names is
    a module decides; absolute imports also look beside the file, last. Relative imports that leave the tree are unresolved.
    """
    asked = (statements(files.where(F.col("path").endswith(".py"))) if imports is None else imports).distinct()
    asked = asked.withColumn("folder", F.regexp_replace("path", "/?[^/]*$", "")).withColumn("deep", F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/"))))
    keys = ["path", "line", "level", "module", "names"]
    up = F.array_join(F.slice(F.split("folder", "/"), F.lit(1), F.col("deep") - F.col("level") + 1), "/")
    near = asked.where((F.col("level") > 0) & (F.col("level") - 1 <= F.col("deep"))).select(*keys, up.alias("base"), F.lit(0).alias("place"))
    starts = roots(files.select("path"))
    far = asked.where("level = 0").crossJoin(F.broadcast(starts)).select(*keys, F.col("root").alias("base"), "place")  # roots of a tree are few
    beside = asked.where("level = 0").select(*keys, F.col("folder").alias("base"), F.lit(1 << 30).alias("place"))
    bases = near.unionByName(far).unionByName(beside)
    inner = F.replace("module", F.lit("."), F.lit("/"))
    joined = lambda *parts: F.concat_ws("/", *(F.nullif(p, F.lit("")) for p in parts))
    tried = bases.select(*keys, "place", F.explode(F.concat(F.array(F.struct(F.lit("").alias("name"), joined(F.col("base"), inner).alias("at"))), F.transform("names", lambda n: F.struct(n.alias("name"), joined(F.col("base"), inner, n).alias("at"))))).alias("c")).select(*keys, "place", "c.name", "c.at")
    py = files.where(F.col("path").endswith(".py")).select(F.col("path").alias("target"))
    package = F.col("target").rlike(r"(^|/)__init__\.py$")
    modules = py.select(F.when(package, F.regexp_replace("target", r"/?__init__\.py$", "")).otherwise(F.regexp_replace("target", r"\.py$", "")).alias("at"), "target", package.alias("is_package"))
    modules = modules.groupBy("at").agg(F.min(F.struct("is_package", "target")).alias("m")).select("at", F.col("m.target").alias("target"))  # a file goes before a package
    hits = tried.join(modules, "at")
    best = hits.groupBy(*keys).agg(F.min("place").alias("best"))
    same = hits.join(best, keys).where("place = best")
    dots = F.repeat(F.lit("."), F.col("level"))
    spec = F.when(F.col("name") == "", F.concat(dots, "module")).when(F.col("module") == "", F.concat(dots, "name")).otherwise(F.concat(dots, "module", F.lit("."), "name"))
    none = F.lit(None).cast("string")
    local = same.select("path", "line", spec.alias("spec"), F.lit("local").alias("kind"), "target", none.alias("package"))
    top = F.split("module", r"\.")[0]
    known = F.create_map(*(F.lit(x) for pair in DISTRIBUTIONS.items() for x in pair))
    builtin = top.isin(*sorted(sys.stdlib_module_names), *LEGACY)
    kind = F.when(F.col("level") > 0, "unresolved").when(builtin, "builtin").when(F.startswith(top, F.lit("_")) & ~top.isin(*DISTRIBUTIONS), "unresolved").otherwise("package")
    name = F.regexp_replace(F.replace(F.lower(F.coalesce(F.try_element_at(known, top), top)), F.lit("_"), F.lit("-")), "^-+|-+$", "")
    rest = asked.join(best, keys, "left_anti").select("path", "line", F.concat(dots, "module").alias("spec"), kind.alias("kind"), none.alias("target"), name.alias("package"))
    return local.unionByName(rest.withColumn("package", F.when(F.col("kind") == "package", F.col("package"))))
