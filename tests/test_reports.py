"""Reports over a small source tree, from its files to the findings."""

import json

import pytest

from linkloom.plans import reports

FILES = {
    "package.json": json.dumps({"name": "p", "main": "src/index.js"}),
    "tsconfig.json": json.dumps({"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}),
    "src/index.ts": "export { used } from './lib/core-thing';\nexport * from '@/lib/star-thing';\n",
    "src/lib/core-thing.ts": "import { low } from './low-thing';\nexport const used = () => low();\nexport const spare = 1;\nconsole.log(spare);\n",
    "src/lib/low-thing.ts": "export function low() { return 1; }\n",
    "src/lib/star-thing.ts": "export const shown = 1;\n",
    "src/lib/BadName.ts": "import { helper } from './dead-helper';\nexport function wrap() { return helper(); }\n",
    "src/lib/dead-helper.ts": "export function helper() { return 2; }\n",
    "src/a.ts": "import './b';\nexport function twin(alpha: number) { const total = alpha + 1; if (total > 3) { return compute(total); } return total * 2; }\n",
    "src/b.ts": "import './a';\nexport function twin(beta: number) { const total = beta + 1; if (total > 3) { return compute(total); } return total * 2; }\n",
    "src/t.test.ts": "import { low } from './lib/low-thing';\njest.mock('./lib/low-thing', () => ({ low: 1, gone: 2 }));\n",
}


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return reports.extract_facts(spark, str(root))


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_audit_and_affected(facts):
    report = reports.audit(facts)
    assert got(report["cycles"], "members") == [(["src/a.ts", "src/b.ts"],)]
    assert {r["node"]: r["fan_in"] for r in report["metrics"].collect()}["src/lib/low-thing.ts"] == 2
    assert got(reports.affected(facts, ["src/lib/low-thing.ts"]), "node") == [("src/index.ts",), ("src/lib/core-thing.ts",), ("src/lib/low-thing.ts",), ("src/t.test.ts",)]


def test_unused(facts):
    report = reports.unused(facts)
    verdict = {(f, n): v for f, n, v in got(report["verdicts"], "file", "name", "verdict")}
    assert verdict[("src/lib/core-thing.ts", "used")] == "public" and verdict[("src/lib/star-thing.ts", "shown")] == "public"
    assert verdict[("src/lib/core-thing.ts", "spare")] == "unused" and verdict[("src/lib/low-thing.ts", "low")] == "used"
    assert got(report["transitively_dead"], "file", "chain") == [("src/lib/dead-helper.ts", ["src/lib/BadName.ts", "src/lib/dead-helper.ts"])]
    assert got(report["mock_orphans"], "key") == [("gone",)]
    assert ("src/lib/BadName.ts", False) in got(report["orphans"], "file", "self_contained")


def test_other_reports(facts):
    assert got(reports.similar(facts), "file") == [("src/a.ts",), ("src/b.ts",)]
    assert got(reports.names(facts), "file", "suggestion") == [("src/lib/BadName.ts", "bad-name")]
    assert got(reports.search(facts, "STAR"), "kind", "name") == [("file", "star-thing.ts")]
    assert got(reports.barrels(facts)["barrels"], "barrel", "total", "wildcard") == [("src/index.ts", 2, 1)]
    assert got(reports.analyze(facts, "src/lib/low-thing.ts")["referenced_by"], "src") == [("src/lib/core-thing.ts",), ("src/t.test.ts",), ("src/t.test.ts",)]
    assert got(reports.organise(facts)["stranded_tests"], "test", "suggested") == [("src/t.test.ts", "src/lib/t.test.ts")] or reports.organise(facts)["stranded_tests"].count() == 1
    assert set(got(reports.tidy_up(facts), "kind")) == {("unused-exports",), ("mock-keys",), ("naming",)}
