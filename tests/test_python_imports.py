"""Python imports over several lines, and the files they mean."""

from sievegrid.operators import python_imports

TREE = {
    "pkg/__init__.py": "", "pkg/a.py": "", "pkg/b/__init__.py": "", "pkg/b/c.py": "from .. import a\nfrom ..a import x\nfrom . import missing\nfrom .... import up\nfrom ..... import gone\nfrom .c import y", "src/lib/mod.py": "", "src/lib.py": "",
    "proj/pyproject.toml": None, "proj/src/own/__init__.py": "", "pkg/near.py": "", "util.py": "", "setup.cfg": None,
    "main.py": 'import os, pkg.a as q, yaml  # import no\nfrom pkg import (\n    a,  # one\n    b as c,\n    zz\n)\n"""\nimport not_this\n"""\nfrom lib import mod; import _x\ns = "import nor_this"\nimport util, \\\n    own\nfrom pkg.b.c import *\nimport Some_Thing_.sub\nif x:\n    import imp\nfoo(import_ = 1)\n',
    "pkg/user.py": "import near\n",
}


def test_statements(spark):
    got = {(r.line, r.level, r.module, tuple(r.names)) for r in python_imports.statements(spark.createDataFrame([("m.py", TREE["main.py"]), ("n.py", None)], "path string, text string")).collect()}
    assert got == {
        (1, 0, "os", ()), (1, 0, "pkg.a", ()), (1, 0, "yaml", ()), (2, 0, "pkg", ("a", "b", "zz")), (10, 0, "lib", ("mod",)), (10, 0, "_x", ()), (12, 0, "util", ()), (12, 0, "own", ()), (14, 0, "pkg.b.c", ()),
        (15, 0, "Some_Thing_.sub", ()), (17, 0, "imp", ()),
    }


def test_resolution(spark):
    files = spark.createDataFrame(list(TREE.items()), "path string, text string")
    got = {(r.path, r.spec, r.kind, r.target or r.package) for r in python_imports.resolved(files).collect()}
    assert {g[1:] for g in got if g[0] == "main.py"} == {
        ("os", "builtin", None), ("pkg.a", "local", "pkg/a.py"), ("yaml", "package", "pyyaml"), ("pkg", "local", "pkg/__init__.py"), ("pkg.a", "local", "pkg/a.py"), ("pkg.b", "local", "pkg/b/__init__.py"),
        ("lib", "local", "src/lib.py"), ("lib.mod", "local", "src/lib/mod.py"), ("_x", "unresolved", None), ("util", "local", "util.py"), ("own", "local", "proj/src/own/__init__.py"), ("pkg.b.c", "local", "pkg/b/c.py"),
        ("Some_Thing_.sub", "package", "some-thing"), ("imp", "builtin", None),
    }
    assert {g[1:] for g in got if g[0] == "pkg/b/c.py"} == {("..", "local", "pkg/__init__.py"), ("..a", "local", "pkg/a.py"), (".", "local", "pkg/b/__init__.py"), ("....", "unresolved", None), (".....", "unresolved", None), (".c", "local", "pkg/b/c.py")}
    assert {g[1:] for g in got if g[0] == "pkg/user.py"} == {("near", "local", "pkg/near.py")}
    assert python_imports.resolved(files.limit(0)).count() == 0
