"""Log files on disk: header blocks, skipped files, rejects, line counts, splits, completeness."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from logtally.operators import headers as H
from logtally.operators import parsing as P
from logtally.plans.harvest import index_text, open_logs
from logtally.sources.discovery import discover_files
from logtally.sources.lines import read_log_lines

DAY = date(2024, 3, 5)
MINIMAL = "#Fields: date time cs-uri-stem cs(User-Agent) cs(Referer) sc-status time-taken X-Forwarded-For"
NO_XFF = "#Fields: date time cs-uri-stem cs(User-Agent) cs(Referer) sc-status time-taken"
MOVED = "#fields: TIME  date SC-STATUS time-taken cs(referer) cs-uri-stem cs(user-agent)"
GOOD = "2024-03-05 10:00:00 /a ua - 200 15 10.0.0.1"


def write(directory, name, content):
    directory.mkdir(exist_ok=True)
    (directory / name).write_bytes(content if isinstance(content, bytes) else content.encode())


def text_of(spark, directory):
    return open_logs(spark, str(directory), [DAY])[0]


def parsed(spark, directory):
    return text_of(spark, directory).parsed()


def rejects(df):
    return [tuple(r) for r in P.reject_lines(df).orderBy("file", "line_no").collect()]


def counts(df):
    return tuple(P.run_summary(P.line_counts(df)).first())


def test_rejects_in_order_of_checks(spark, tmp_path):
    lines = [
        GOOD,  # before any header
        MINIMAL,
        GOOD,
        "2024-03-05 10:00:00 /a ua - 200",
        "2024-02-30 10:00:00 /a ua - 2x0 1.5 -",
        "2024-03-05 10:00:00 /a ua - 2x0 1.5 -",
        "2024-03-05 10:00:00 /a ua - 200 1.5 -",
        "",
        " \t ",
        "#Remark",
        GOOD + "  ",
    ]
    write(tmp_path, "u_ex240305_x_1.log", "\n".join(lines))
    df = parsed(spark, tmp_path)
    name = "u_ex240305_x_1.log"
    assert rejects(df) == [
        (name, 1, "no header block seen yet"),
        (name, 4, "field count mismatch (expected 8, got 6)"),
        (name, 5, "unparseable date/time '2024-02-30 10:00:00'"),
        (name, 6, "unparseable status '2x0'"),
        (name, 7, "unparseable time-taken '1.5'"),
    ]
    assert counts(df) == (7, 2, 5)


def test_each_line_reads_with_its_own_header(spark, tmp_path):
    write(
        tmp_path,
        "u_ex240305.log",
        "\n".join([MINIMAL, GOOD, NO_XFF, "2024-03-05 11:00:00 /b ua r 404 7", MOVED, "12:00:00 2024-03-05 500 9 ref /c agent", MINIMAL, GOOD]),
    )
    rows = P.valid_requests(parsed(spark, tmp_path)).orderBy("utc_ts", "line_id").collect()
    assert [(r.uri_stem, r.referer, r.status, r.time_taken_ms, r.forwarded_for) for r in rows] == [
        ("/a", "-", 200, 15, "10.0.0.1"),
        ("/a", "-", 200, 15, "10.0.0.1"),
        ("/b", "r", 404, 7, None),
        ("/c", "ref", 500, 9, None),
    ]


def test_repeated_field_name_takes_the_last_place(spark, tmp_path):
    write(tmp_path, "u_ex240305.log", NO_XFF + " sc-status\n2024-03-05 10:00:00 /a ua - 200 15 503\n")
    assert [r.status for r in parsed(spark, tmp_path).collect()] == [503]


def test_skipped_files(spark, tmp_path):
    write(tmp_path, "u_ex240305_x_1.log", GOOD + "\n")
    write(tmp_path, "u_ex240305_x_2.log", "\n".join([MINIMAL, GOOD, "#Fields: date time sc-status time-taken", GOOD]))
    write(tmp_path, "u_ex240305_x_3.log", "")
    write(tmp_path, "u_ex240305_x_4.log", MINIMAL + "\n" + GOOD)
    text = text_of(spark, tmp_path)
    assert [(r.file, r.reason) for r in text.skipped.orderBy("file").collect()] == [
        ("u_ex240305_x_1.log", "no #Fields header block found"),
        ("u_ex240305_x_2.log", "header block at line 3 is missing required field(s): cs-uri-stem, cs(User-Agent), cs(Referer)"),
        ("u_ex240305_x_3.log", "no #Fields header block found"),
    ]
    assert counts(text.parsed()) == (1, 1, 0)


@pytest.mark.parametrize("ending", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("mark", [b"", b"\xef\xbb\xbf"])
def test_line_endings_and_byte_order_mark(spark, tmp_path, ending, mark):
    write(tmp_path, "u_ex240305.log", mark + ending.join([MINIMAL, GOOD, "", GOOD]).encode())
    assert counts(parsed(spark, tmp_path)) == (2, 2, 0)


def test_only_matching_names_in_the_top_folder(spark, tmp_path):
    for name in ("u_ex240305_a.log", "u_ex240306.log", "u_ex240309.log", "u_ex240305.txt", "x_ex240305.log", "u_ex249905.log"):
        write(tmp_path, name, MINIMAL)
    write(tmp_path / "sub", "u_ex240305_b.log", MINIMAL)
    files = discover_files(spark, str(tmp_path), [date(2024, 3, 5), date(2024, 3, 6)])
    assert sorted((r.file, r.file_utc_date) for r in files.collect()) == [
        ("u_ex240305_a.log", date(2024, 3, 5)),
        ("u_ex240306.log", date(2024, 3, 6)),
    ]


def test_header_carries_over_input_splits(spark, tmp_path):
    """One file read in many splits, its headers alternating at uneven places, gives what a plain
    walk over the lines gives; through both join forms."""
    lines, expected, current = [], [], None
    for i in range(3000):
        if i % 97 == 5 or i % 250 == 0:
            current = MINIMAL if (i // 97) % 2 else NO_XFF
            lines.append(current)
        lines.append(f"2024-03-05 10:00:00 /p{i} ua - 200 {i}" + (" 10.0.0.1" if current is MINIMAL else ""))
        expected.append((len(lines), f"/p{i}", "10.0.0.1" if current is MINIMAL else None))
    write(tmp_path, "u_ex240305.log", "\n".join(lines))
    keys = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        text = index_text(read_log_lines(spark, str(tmp_path), [DAY]))
        assert text.splits.count() > 20
        for layouts in (text.layouts, text.layouts.hint("merge")):
            df = P.parse_lines(H.header_blocks(text.lines, layouts))
            assert df.where("reason is not null").count() == 0
            got = df.orderBy("line_no").select("line_no", "uri_stem", "forwarded_for").collect()
            assert [tuple(r) for r in got] == expected
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_plan_of_parsing(spark, tmp_path):
    write(tmp_path, "u_ex240305.log", MINIMAL + "\n" + GOOD)
    plan = P.valid_requests(parsed(spark, tmp_path)).groupBy("uri_stem").agg(F.sum("status"))._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert "Python" not in physical
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical
    # Lines are split once, whatever tests come later, and not shuffled before they are grouped.
    assert physical.count("split(line") <= 2
    assert physical.count("Exchange hashpartitioning") == 1


def test_log_files_are_moved_without_asking_for_each(spark, tmp_path, monkeypatch):
    from logtally.sinks.files import SharedFiles
    from logtally.sources.accesslog import write_log_files

    monkeypatch.setattr(SharedFiles, "publish", lambda *_: pytest.fail("one rename after the other"))
    rows = [(f"u_ex2401{d:02d}_x_0a.log", e, 1, f"{d} {e}") for d in range(1, 31) for e in (2, 1)]
    target = write_log_files(spark.createDataFrame(rows, "file string, event_id long, kind int, line string"), f"{tmp_path}/logs")
    assert {p.name: p.read_text() for p in (tmp_path / "logs").glob("*.log")} == {
        f"u_ex2401{d:02d}_x_0a.log": f"{d} 1\n{d} 2\n" for d in range(1, 31)
    }
    assert not (tmp_path / "logs" / "staging").exists()
    with pytest.raises(ValueError):
        SharedFiles(spark, target).move({f"{target}/a": f"{target}/c", f"{target}/b": f"{target}/c"})
