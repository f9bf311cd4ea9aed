"""Versions, ranges, OSV records and fix plans."""

import json

from pyspark.sql import functions as F

from sievegrid.functions import text as tx
from sievegrid.functions import versions as vs
from sievegrid.operators import advisories as adv


def test_pep440_order(spark):
    order = ["1.0.dev1", "1.0a1.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0+abc", "1.0+5", "1.0.post1.dev2", "1.0.post1", "1.0.1", "1.1", "1.10", "1!0.1"]
    rows = spark.createDataFrame([(v,) for v in reversed(order)], "v string").withColumn("key", vs.pep440(F.col("v")))
    assert [r.v for r in rows.orderBy("key").collect()] == order
    same = spark.createDataFrame([("1.0", "1"), ("1.0-1", "1.0.post1"), ("1.0ALPHA1", "1.0a1"), ("v1.0c2", "1rc2")], "a string, b string").select((vs.pep440(F.col("a")) == vs.pep440(F.col("b"))).alias("x"))
    assert all(r.x for r in same.collect())
    bad = spark.createDataFrame([("",), ("x",), ("1.0.x",), (None,)], "v string").select(vs.pep440(F.col("v")).alias("x"))
    assert all(r.x is None for r in bad.collect())
    stable = {"1.0": True, "1.0rc1": False, "1.0.dev3": False, "1.0.post1": True, "x": False}
    got = spark.createDataFrame([(v,) for v in stable], "v string").select("v", vs.is_stable(F.lit("PyPI"), F.col("v")).alias("x")).collect()
    assert {r.v: r.x for r in got} == stable


def test_ranges(spark):
    npm = [
        ("1.2.3", "^1.2.3", True), ("2.0.0", "^1.2.3", False), ("0.2.9", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("0.0.4", "^0.0.3", False), ("1.9.9", "1.x", True), ("1.2.9", "~1.2", True), ("1.3.0", "~1.2.3", False),
        ("1.5.0", ">=1.0.0 <1.5.0", False), ("1.5.0", ">=1.0.0  < 1.6", True), ("3.0.0", "<2 || >=3", True), ("1.3.0", "1.2.3 - 1.3", True), ("1.4.0", "1.2.3 - 1.3", False), ("1.0.0", "", True), ("1.0.0-rc.1", "*", False),
        ("1.2.3-beta.2", ">=1.2.3-beta.1", True), ("1.2.4-beta.2", ">=1.2.3-beta.1", False), ("1.2.3", "=1.2.3", True), ("1.2.3", "v1.2.3", True), ("1.2.3", "latest", False), ("bad", "*", False), ("1.2.3", ">1.2.3", False), ("1.3.0", ">1.2", True), ("1.2.9", ">1.2", False),
    ]
    pypi = [
        ("1.4.5", "==1.4.*", True), ("1.5", "==1.4.*", False), ("1.4", "!=1.4.*", False), ("2.2.1", "~=2.2", True), ("3.0", "~=2.2", False), ("2.2.9", "~=2.2.1", True), ("2.3", "~=2.2.1", False), ("1.0", ">=1,<2", True), ("2.0", ">=1,<2", False),
        ("1.0rc1", ">=0.9", False), ("1.0rc1", ">=1.0rc1", True), ("1.0.post1", ">1.0", False), ("1.0+local", "==1.0", True), ("1.0", "===1.0", True), ("1.0", "nonsense", False), ("1.0", "", True), ("2.0rc1", "<2.0", False),
    ]
    for eco, cases in (("npm", npm), ("PyPI", pypi)):
        rows = spark.createDataFrame(cases, "v string, r string, want boolean").withColumn("got", vs.satisfies(F.lit(eco), F.col("v"), F.col("r"))).collect()
        assert {(r.v, r.r): r.got for r in rows} == {(v, r): w for v, r, w in cases}
    jumps = spark.createDataFrame([("npm", "0.1.0", "0.2.0", "major"), ("PyPI", "0.1", "0.2", "minor"), ("PyPI", "1", "1.0.1", "patch"), ("npm", "x", "1.0.0", None)], "e string, a string, b string, want string")
    assert all(r.want == r.got for r in jumps.withColumn("got", vs.version_jump(F.col("e"), F.col("a"), F.col("b"))).collect())


def test_cvss_bands_and_version_four(spark):
    v4 = {"CVSS:4.0/AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:N/SI:N/SA:N": 9.2, "CVSS:4.0/AV:N/AC:L/AT:N/PR:N/UI:N/VC:N/VI:N/VA:N/SC:N/SI:N/SA:N": 0.0, "CVSS:4.0/AV:N": None, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": None}
    rows = spark.createDataFrame([(v,) for v in v4], "v string").select("v", tx.cvss4(F.col("v")).alias("x")).collect()
    assert {r.v: r.x for r in rows} == v4
    bands = spark.createDataFrame([(s,) for s in (0.0, 0.1, 3.9, 4.0, 6.9, 7.0, 8.9, 9.0, None)], "s double").select(tx.cvss_severity(F.col("s")).alias("x")).collect()
    assert [r.x for r in bands] == ["info", "low", "low", "medium", "medium", "high", "high", "critical", None]


def test_osv_records(spark):
    event = lambda **e: e
    records = [
        {"id": "A", "affected": [{"package": {"ecosystem": "PyPI", "name": "Foo_Bar"}, "ranges": [{"type": "ECOSYSTEM", "events": [event(introduced="0"), event(fixed="1.0"), event(introduced="2.0"), event(last_affected="2.5")]}], "ecosystem_specific": {"affects": {"functions": ["f"]}}},
                                 {"package": {"ecosystem": "PyPI", "name": "foo-bar"}, "versions": ["9.9"]}], "references": [{"type": "WEB", "url": "w"}, {"type": "ADVISORY", "url": "a"}], "database_specific": {"severity": "HIGH"}},
        {"id": "MAL-1", "affected": [{"package": {"ecosystem": "npm", "name": "evil"}}]},
        {"id": "L", "affected": [{"package": {"ecosystem": "npm", "name": "lim"}, "ranges": [{"type": "SEMVER", "events": [event(introduced="1.0.0"), event(limit="1.5.0")]}]}]},
        {"id": "E", "affected": [{"package": {"ecosystem": "npm", "name": "none"}, "versions": []}]},
    ]
    entries = adv.parsed(spark.createDataFrame([(json.dumps(r),) for r in records] + [("oops",), (None,)], "json string"))
    a = entries.where("advisory = 'A'").first()
    assert [tuple(r) for r in a.ranges] == [("0", "1.0", None), ("2.0", None, "2.5")] and a.versions == ["9.9"] and a.fixed == ["1.0"] and a.symbols == ["f"] and (a.severity, a.url, a.malicious) == ("high", "a", False)
    packages = [("PyPI", "foo.bar", v) for v in ("0.9", "1.0", "2.2", "2.6", "9.9")] + [("npm", "evil", "1.0.0"), ("npm", "lim", "1.4.9"), ("npm", "lim", "1.5.0"), ("npm", "none", "1.0.0"), ("npm", "lost", "1.0.0")]
    failed = spark.createDataFrame([("npm", "lost")], "ecosystem string, name string")
    found = adv.advisories_for(spark.createDataFrame(packages, "ecosystem string, name string, version string"), entries, failed)
    assert {(r.name, r.version, r.advisory) for r in found.collect()} == {("foo.bar", "0.9", "A"), ("foo.bar", "2.2", "A"), ("foo.bar", "9.9", "A"), ("evil", "1.0.0", "MAL-1"), ("lim", "1.4.9", "L"), ("lost", "1.0.0", "unavailable")}
    cases = spark.createDataFrame([("1.0.0", None, None, None), ("1.0.0", None, [], False), ("1.0.0", [("0", None, None)], None, True), ("x", [("1.0.0", None, None)], None, False)], f"v string, r {adv.RANGES}, l array<string>, want boolean")
    assert all(r.want == r.got for r in cases.withColumn("got", adv.is_affected(F.lit("npm"), F.col("v"), F.col("r"), F.col("l"))).collect())


def test_fix_plan(spark):
    vulnerable = [
        ("s", "f1", "npm", "", "package-lock.json", "direct", "1.0.0", True, True, 10), ("s", "f2", "npm", "", "package-lock.json", "inner", "1.0.0", False, False, 20), ("s", "f3", "npm", "", "package-lock.json", "deep", "1.0.0", False, False, 30),
        ("s", "f4", "npm", "", "package-lock.json", "stuck", "1.0.0", True, False, 40), ("s", "f5", "PyPI", "x", "x/requirements.txt", "py", "1.0", True, False, 5), ("s", "f6", "npm", "", "package-lock.json", "fresh", "1.0.0", False, False, 7),
        ("s", "f7", "npm", "", "package-lock.json", "apart", "1.0.0", True, False, 9),
    ]
    v = spark.createDataFrame(vulnerable, "scan_id string, finding_id string, ecosystem string, manifest_dir string, lockfile string, name string, version string, direct boolean, dev boolean, risk int")
    r = lambda fixed, a="0": [(a, fixed, None)]
    advisories = [
        ("f1", "A1", r("1.2.0"), None, ["1.2.0"], False), ("f1", "A2", [("1.2.0", "2.0.0", None)], None, ["2.0.0"], False), ("f2", "A3", r("1.1.0"), None, ["1.1.0"], False), ("f3", "A4", r("1.1.0"), None, ["1.1.0"], False),
        ("f4", "A5", r(None), None, [], False), ("f5", "A6", None, None, ["1.5", "0.5"], False), ("f6", "A7", r("1.0.5"), None, ["1.0.5"], False), ("f7", "A8", r("1.1.0"), None, [], False), ("f7", "A9", [("1.1.0", None, None)], None, [], True),
    ]
    a = spark.createDataFrame(advisories, f"finding_id string, advisory string, ranges {adv.RANGES}, versions array<string>, fixed array<string>, unavailable boolean")
    published = [("direct", "1.2.0"), ("direct", "2.0.0-rc.1"), ("direct", "2.0.0"), ("inner", "1.1.0"), ("inner", "1.2.0"), ("deep", "1.1.0"), ("stuck", "2.0.0"), ("fresh", "1.0.5"), ("fresh", "1.0.6"), ("par", "1.0.0"), ("par", "1.1.0"), ("par", "2.0.0"), ("apart", "1.1.0")]
    p = spark.createDataFrame([("npm", *x) for x in published], "ecosystem string, name string, published string")
    parents = spark.createDataFrame([("f2", "par", "1.0.0", False, True), ("f3", "par", "1.0.0", False, True), ("f3", "q", "1.0.0", False, False), ("f6", "par", "1.0.0", False, True)], "finding_id string, parent string, parent_version string, parent_dev boolean, root boolean")
    ranges = [("par", "1.0.0", "inner", "~1.0.0"), ("par", "1.1.0", "inner", "1.0.x"), ("par", "2.0.0", "inner", None), ("par", "1.0.0", "deep", "^1.0.0"), ("q", "1.0.0", "deep", "1.0.0"), ("par", "1.0.0", "fresh", "~1.0.0"), ("par", "1.1.0", "fresh", "*")]
    g = spark.createDataFrame([("npm", *x) for x in ranges], "ecosystem string, parent string, parent_version string, child string, range string")
    plan = {(x.kind, x.package): x for x in adv.fix_plan(v, a, p, parents, g).collect()}
    brief = {k: (x["from"], x.to, x.refresh, x.effort, x.advisories, x.risk, x.command) for k, x in plan.items()}
    assert brief == {
        ("upgrade-direct", "direct"): ("1.0.0", "2.0.0", False, 5, 2, 10, "npm install -D direct@2.0.0"), ("upgrade-parent", "par"): ("1.0.0", "2.0.0", False, 5, 1, 20, "npm install par@2.0.0"),
        ("override", "deep"): ("1.0.0", "1.1.0", False, 3, 1, 30, 'add to package.json: "overrides": { "deep": "1.1.0" } — then run `npm install`'), ("remove", "stuck"): ("1.0.0", None, False, 5, 1, 40, "npm uninstall stuck"),
        ("upgrade-direct", "py"): ("1.0", "1.5", False, 2, 1, 5, "set `py==1.5` in requirements.txt"), ("override", "fresh"): ("1.0.0", "1.0.5", True, 3, 1, 7, "npm update fresh"), ("upgrade-direct", "apart"): ("1.0.0", "1.1.0", False, 2, 1, 9, "npm install apart@1.1.0"),
    }
    assert len({x.id for x in plan.values()}) == 7 and plan["upgrade-direct", "py"].merge_key.endswith("|x/requirements.txt")
    lost = {(x.finding_id, x.advisory): x.reason for x in adv.safe_upgrades(v, a, p)[1].collect()}
    assert lost == {("f4", "A5"): "no fixed version published", ("f7", "A9"): "advisory details unavailable"}
