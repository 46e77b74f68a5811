"""Case reader (S8) and findings flattening (Q14)."""

import json

import pytest

from lakecart.sources import reports


def _write(path, lines):
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")


def _case(i, kind="domain", split="dev"):
    return json.dumps({"id": i, "split": split, "metadata": {"kind": kind, "source": "x"}, "history": [],
                       "input": "hola", "expected": {"in_domain": True}, "extra": 1})


def test_read_cases(spark, scratch):
    p = f"{scratch}/cases.jsonl"
    _write(p, [_case("a"), _case("b", "tools", "test")])
    assert reports.read_cases(spark, p).count() == 2
    assert [r.id for r in reports.read_cases(spark, p, "test").collect()] == ["b"]
    with pytest.raises(reports.CaseError):
        reports.read_cases(spark, p, "train")
    _write(p, [_case("a"), _case("a")])
    with pytest.raises(reports.CaseError):
        reports.read_cases(spark, p)
    _write(p, [_case("a", "weird")])
    with pytest.raises(reports.CaseError):
        reports.read_cases(spark, p)


def test_flatten_findings(spark, scratch):
    p = f"{scratch}/report.json"
    doc = {"Results": [
        {"Target": "a.txt", "Vulnerabilities": [{"Severity": "HIGH", "VulnerabilityID": "CVE-1", "StartLine": 3}],
         "Secrets": [{"Severity": "LOW", "RuleID": "r1", "CauseMetadata": {"StartLine": 9}}]},
        {"Target": "b.txt", "Misconfigurations": [{"Severity": "MEDIUM", "ID": "M1"}]},
        {"Target": "c.txt"}]}
    with open(p, "w") as fh:
        json.dump(doc, fh)
    rows = sorted((r.severity, r.identifier, r.target, r.line) for r in reports.flatten_findings(spark, p).collect())
    assert rows == [("HIGH", "CVE-1", "a.txt", 3), ("LOW", "r1", "a.txt", 9), ("MEDIUM", "M1", "b.txt", None)]
