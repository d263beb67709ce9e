"""Delimited files against a reader that goes character by character."""

import random

import pytest

from reconcile.sources import records, staged
from reconcile.sources.staged import CORRUPT

COLUMNS = ("a", "b", "c")


def _slow_lines(text):
    lines = text.split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def _slow_field(text):
    """The length of the field at the beginning of ``text``, and its value; None where it is none."""
    if text.startswith('"'):
        at, value = 1, ""
        while at < len(text):
            if text[at] != '"':
                value += text[at]
            elif text[at + 1 : at + 2] == '"':
                value += '"'
                at += 1
            else:
                return (at + 1, value) if text[at + 1 : at + 2] in ("", ",") else None
            at += 1
        return None
    at, value = 0, ""
    while at < len(text) and text[at] != ",":
        if text[at] == "\\" and at + 1 < len(text):
            at += 1
            value += {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}.get(text[at], text[at])
        else:
            value += text[at]
        at += 1
    return at, value


def _slow_record(text):
    text = text.removesuffix("\r")
    at, values, starts = 0, [], []
    while True:
        starts.append(at + 1)
        field = _slow_field(text[at:])
        if field is None:
            return None, starts, text
        at += field[0]
        values.append(field[1])
        if at >= len(text):
            return values, starts, text
        at += 1


def _open(text):
    """Whether a record so far ends inside quotes."""
    at = 0
    while True:
        if text[at : at + 1] == '"':
            rest = text[at + 1 :].replace('""', "  ")
            end = rest.find('"')
            if end < 0:
                return True
            if rest[end + 1 : end + 2] not in ("", ","):
                return False
            at += end + 2
        else:
            field = _slow_field(text[at:])
            at += field[0]
        if at >= len(text):
            return False
        at += 1


def _slow(text, multi_line):
    found, line_no, offset = [], 0, 0
    lines = _slow_lines(text)
    while line_no < len(lines):
        first, begin, record = line_no, offset, lines[line_no]
        offset += len(lines[line_no].encode()) + 1
        line_no += 1
        while multi_line and _open(record) and line_no < len(lines):
            record += "\n" + lines[line_no]
            offset += len(lines[line_no].encode()) + 1
            line_no += 1
        found.append((first + 1, begin, *_slow_record(record)))
    return found


def _random_text(draw):
    def field():
        kind = draw.random()
        if kind < 0.25:
            return '"' + "".join(draw.choice(['x', ',', '""', "\\", "\n", "é"]) for _ in range(draw.randrange(6))) + '"'
        if kind < 0.3:
            return draw.choice(['"a"b', '"', 'a"b', '"open', "\\", 'x"'])
        return "".join(draw.choice(["x", "7", "\\,", "\\\\", "\\n", "\\q", " ", "é", "\t"]) for _ in range(draw.randrange(5)))

    lines = [",".join(field() for _ in range(draw.choice([3, 3, 3, 2, 4]))) + draw.choice(["", "", "\r"]) for _ in range(draw.randrange(1, 60))]
    return "a,b,c\n" + "\n".join(lines) + draw.choice(["", "\n"])


@pytest.fixture
def small_blocks(spark, monkeypatch):
    monkeypatch.setattr(records, "_CHUNK_BITS", 2)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("multi_line", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_random_files_split_anywhere(spark, tmp_path, small_blocks, seed, multi_line):
    draw = random.Random(seed)
    texts = [_random_text(draw) for _ in range(6)]
    for i, text in enumerate(texts):
        (tmp_path / f"f{i}.csv").write_bytes(text.encode())
    lines = records.read_lines(spark, str(tmp_path))
    assert lines.select("_block").distinct().count() > 1
    parsed = records.parse_records(lines, COLUMNS, multi_line=multi_line)
    got = sorted((tuple(r[c] for c in COLUMNS) if r[CORRUPT] is None else r[CORRUPT] for r in parsed.collect()), key=repr)
    slow = {f"f{i}.csv": _slow(text, multi_line)[1:] for i, text in enumerate(texts)}
    wanted = [tuple(values) if values is not None and len(values) == 3 else record for rows in slow.values() for _, _, values, _, record in rows]
    assert got == sorted(wanted, key=repr)

    types = {"a": "string", "b": "int", "c": "string"}
    checked = staged.check_rows(parsed, types)
    rejects = records.reject_records(checked, lines, types)
    got = sorted((r["file"].rpartition("/")[2], r["row_number"], r["row_start_line"], r["byte_offset"], r["character"], r["category"], r["rejected_record"]) for r in rejects.collect())
    wanted = []
    for name, rows in slow.items():
        for number, (line, offset, values, starts, record) in enumerate(rows, 1):
            if values is None or len(values) != 3:
                at = starts[-1] if values is None else starts[3] if len(values) > 3 else len(record) + 1
                wanted.append((name, number, line, offset, at, "parsing", record))
            elif values[1] not in ("", "NULL", "NUL") and not values[1].strip().isdigit():
                wanted.append((name, number, line, offset, starts[1], "conversion", record))
    assert got == sorted(wanted)
    whole = {f"f{i}.csv": t.encode() for i, t in enumerate(texts)}
    assert all(whole[name][offset:].startswith(record.encode()) for name, _, _, offset, _, _, record in got)


def test_a_quote_that_never_ends_is_one_bounded_record(spark, tmp_path, monkeypatch, small_blocks):
    monkeypatch.setattr(records, "MOST_RECORD_BYTES", 40)
    (tmp_path / "f.csv").write_text('a,b,c\n1,"x\ny",3\n2,"never\n' + "4,5,6\n" * 100)
    lines = records.read_lines(spark, str(tmp_path))
    rows = records.parse_records(lines, COLUMNS, multi_line=True).orderBy("_block", "_row").collect()
    assert [(r["b"], r[CORRUPT]) for r in rows] == [("x\ny", None), (None, '2,"never')]


def test_empty_files_and_headers(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("a,b,c\n")
    (tmp_path / "one.csv").write_text("a,b,c\na,b,c")
    lines = records.read_lines(spark, str(tmp_path))
    for multi_line in (False, True):
        assert [tuple(r)[3:6] for r in records.parse_records(lines, COLUMNS, multi_line=multi_line).collect()] == [("a", "b", "c")]
        assert records.parse_records(lines, COLUMNS, header=False, multi_line=multi_line).count() == 3
