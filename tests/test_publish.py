"""Batches of run files appear by their manifest or not at all; a run's report is complete."""

import json
import os

import pytest
from pyspark.sql import functions as F

from scholarmatch.operators import manual_run
from scholarmatch.sources import export, publish

ODD = ["r.1", "a/b c+d%2F", "运行-1", "x"]


def _files(spark, ids, text="t"):
    return spark.createDataFrame([(i, n, f"{text} {i}\n{n}") for i in ids for n in ("report.md", "report.json")], publish.SHAPE).repartition(3)


def _read(spark, path):
    return sorted(tuple(r) for r in publish.read_published(spark, path).collect())


def test_files_are_read_back_under_their_names(spark, tmp_path):
    path = str(tmp_path / "out")
    assert publish.read_published(spark, path).count() == 0 and not publish.is_published(path, "b")
    assert publish.publish(_files(spark, ODD), path, "b.1/x")
    assert _read(spark, path) == sorted(("b.1/x", i, n, f"t {i}\n{n}") for i in ODD for n in ("report.md", "report.json"))
    assert publish.publish(_files(spark, ["y"]).limit(0), path, "empty") and publish.is_published(path, "empty")
    assert len(_read(spark, path)) == 8


def test_small_files_do_not_take_a_block_each(spark, tmp_path):
    ids = [f"r{i}" for i in range(300)]
    odd = spark.createDataFrame([("e", "none", None), ("e", "lines", "a\u2028b\r\n\n"), ("e", "wide", "运行 \U0001f600")], publish.SHAPE)
    assert publish.publish(_files(spark, ids).unionByName(odd).coalesce(2), str(tmp_path), "one")
    packs = [p for p in (tmp_path / "files").rglob("*") if p.is_file()]
    assert len(packs) == 2 and sum(p.stat().st_size for p in packs) < 20_000
    got = _read(spark, str(tmp_path))
    assert [g[2:] for g in got if g[1] == "e"] == [("lines", "a\u2028b\r\n\n"), ("none", ""), ("wide", "运行 \U0001f600")] and len(got) == 603


def test_a_task_begins_another_pack(tmp_path, monkeypatch):
    from types import SimpleNamespace as Row

    monkeypatch.setattr(publish, "PACK", 100)
    writer = publish._Writer({"path": str(tmp_path), "batch": "b"})
    done = writer.write(iter([Row(run_id=f"r{i}", name="n", content="x" * 60) for i in range(5)]))
    assert done.files == 5 and len(list((tmp_path / done.folder).iterdir())) == 3
    assert writer.write(iter([])).files == 0


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path)
    assert publish.publish(_files(spark, ["a"]), path, "one")
    before = _read(spark, path)
    assert not publish.publish(_files(spark, ["a", "b"], "other"), path, "one")
    assert _read(spark, path) == before
    assert publish.publish(_files(spark, ["b"]), path, "two") and len(_read(spark, path)) == 4


def test_a_batch_that_breaks_off_shows_nothing(spark, tmp_path):
    path = str(tmp_path)

    def fail(batches):
        import pandas as pd

        for rows in batches:
            if (rows["run_id"] == "bad").any():
                raise ValueError("broken off")
            yield rows

    good = _files(spark, ["a", "b", "c"])
    broken = good.unionByName(_files(spark, ["bad"]).coalesce(1)).mapInPandas(fail, publish.SHAPE)
    with pytest.raises(Exception, match="broken off"):
        publish.publish(broken, path, "one")
    assert not publish.is_published(path, "one") and _read(spark, path) == []
    assert publish.publish(good, path, "one") and len(_read(spark, path)) == 6


def test_folders_outside_the_manifest_are_not_read(spark, tmp_path):
    path = str(tmp_path)
    publish.publish(_files(spark, ["a"]), path, "one")
    stray = tmp_path / "files" / ("one-" + "0" * 32)
    os.makedirs(stray)
    (stray / "a.report.md").write_text("from a task that was run twice")
    assert len(_read(spark, path)) == 2


def test_only_manifests_are_listed_by_the_driver(spark, tmp_path):
    path = str(tmp_path)
    publish.publish(_files(spark, ODD), path, "one")
    assert all("/manifests/" in f for f in publish.read_published(spark, path).inputFiles())


def test_report_documents_hold_every_section(spark):
    run = lambda rows, shape: spark.createDataFrame([("r1", *r) for r in rows], "run_id string" + (", " + shape if shape else ""))
    nested = export.run_reports(
        spark.createDataFrame([("r1", "OPEN"), ("r2", None)], "run_id string, recruiting string"),
        run([("CONFIRMED", "A1", ["name", "mail"], ["dept"])], "status string, selected_author_id string, reasons array<string>, conflicts array<string>"),
        run([(1, "title", "Prof"), (0, "name", "Ann")], "pos int, key string, value string"),
        run([(0, "declared", "ML", "DECLARED"), (1, "observed", "NLP", "EMERGING")], "pos int, kind string, topic string, trend string"),
        run([("STRONG", "WORTH_CONTACTING", "OPEN", "ask?")], "research_fit string, recommendation string, opportunity_signal string, question string"),
        run([(0, "topics", "strength"), (1, "skills", "weakness")], "pos int, label string, standing string"),
        run([("g2",), ("g1",)], "topic string"),
        run([("e2", "PAPER", "", None), ("e1", "PAGE", "Home", "http://h")], "id string, source_type string, title string, source_url string"),
        run([("Hello",)], "subject string"),
        run([(1, "second"), (0, "first")], "idx int, text string"),
        run([(0, "careful")], "pos int, text string"),
    )
    files = {(r["run_id"], r["name"]): r["content"] for r in export.report_files(nested, "2024-01-01").collect()}
    assert files["r1", "report.md"].split("\n") == [
        "# 导师研究报告", "", "- 生成时间：2024-01-01", "- 运行 ID：r1", "", "## 身份确认", "- 状态：CONFIRMED", "- 选定作者：A1", "- 依据：name, mail", "- 冲突：dept",
        "", "## 导师画像", "- name：Ann", "- title：Prof", "- 官网声明方向：ML", "- 近年论文观察主题：NLP(EMERGING)", "- 招生状态：OPEN",
        "", "## 匹配分析", "- 研究匹配：STRONG", "- 建议：WORTH_CONTACTING", "- 机会信号：OPEN", "- 强项：topics", "- 缺口：g1、g2", "- 待询问：ask?",
        "", "## 证据来源", "- [PAGE] Home（http://h）", "- [PAPER] e2（）", "", "## 邮件草稿", "主题：Hello", "- first", "- second", "", "## 警告", "- careful",
    ]
    bare = files["r2", "report.md"]
    assert "- 招生状态：UNKNOWN" in bare and "- 无" in bare and "## 警告" not in bare and "主题" not in bare
    data = json.loads(files["r1", "report.json"])
    assert data["draft"] == {"subject": "Hello", "sentences": ["first", "second"]} and data["match_report"]["gaps"] == ["g1", "g2"] and data["evidences"][0]["id"] == "e1"


def test_a_run_keeps_what_its_evidence_backs(spark):
    facts = spark.createDataFrame(
        [("s", "f1", "skill", "graph", "FACT", True), ("s", "f2", "skill", "secret", "INFERRED", False)],
        "student_id string, fact_id string, field string, value string, status string, user_confirmed boolean",
    )
    people = spark.createDataFrame([("p", True, "Ann")], "professor_id string, identity_confirmed boolean, name string")
    mats = spark.createDataFrame(
        [("p", 0, "declared", "graph", "page"), ("p", 1, "observed", "optics", "page"), ("p", 2, "text", "A paper", "lost")],
        "professor_id string, pos int, kind string, topic string, evidence_id string",
    )
    known = spark.createDataFrame([("p", "page", "PAGE", "", None, "CONFIRMED")], "professor_id string, id string, source_type string, title string, source_url string, author_resolution_status string")
    claims = spark.createDataFrame([("s-p", "c1", "generic", "SUPPORTED", ["page"]), ("s-p", "c2", "generic", "SUPPORTED", ["ghost"])], "run_id string, claim_id string, claim_type string, status string, evidence_ids array<string>")
    points = spark.createDataFrame(
        [("s-p", "1", "research_intersection", "x", ["s:f1", "s:f2"], ["page", "ghost"]), ("s-p", "2", "research_intersection", "y", ["s:f2"], ["page"])],
        "run_id string, point_id string, section string, text string, fact_ids array<string>, evidence_ids array<string>",
    )
    asked = spark.createDataFrame([("s", "p")], "student_id string, professor_id string")
    hits = spark.createDataFrame(
        [("s", "p", "f1", 1, "skill", "graph", "graph", 0, "declared", "page")],
        "student_id string, professor_id string, fact_id string, fact_pos int, field string, term string, topic string, pos int, kind string, evidence_id string",
    )
    found = manual_run.manual_runs(asked, facts, asked.selectExpr("student_id", "'Lin' AS name"), people, mats, known, claims, points, hits)
    assert [r["claim_id"] for r in found["claims"].collect()] == ["c1"]
    assert [(r["point_id"], r["fact_ids"], r["evidence_ids"]) for r in found["points"].collect()] == [("1", ["s:f1"], ["page"])]
    said = [r["text"] for r in found["sentences"].orderBy("idx").collect()]
    assert not any("A paper" in t for t in said) and any("graph" in t for t in said) and said[-1] == "Lin"
    assert tuple(found["checks"].first()) == ("s-p", 1, True)
    assert [r["text"] for r in found["warnings"].orderBy("pos").collect()] == ["未配置 LLM，已使用事实锁定模板", "移除 1 句无来源句子"]
    assert [r["topic"] for r in found["gaps"].collect()] == ["optics"] and found["reports"].first()["research_fit"] == "STRONG"
    assert found["evidence"].select(F.col("id")).first()[0] == "page"
