import csv
import datetime as dt
import io
import re

from loomcast.operators import malformed

LINES = [
    (1, "a", 1, "﻿event_date,lat,lon,fatalities,note"),
    (2, "a", 2, '2024-01-02,1.5,2.5,0,"said ""all clear"", left"'),
    (3, "a", 3, '2024-02-30,1.5,181,0,x'),
    (4, "a", 4, '2024-01-02,1.5,2.5,0,"open'),
    (5, "a", 5, '2024-01-02,1.5,2.5,0,in "the" field'),
    (6, "a", 6, '2024-01-02,1.5,2.5,0,"closed"x'),
    (7, "a", 7, "2024-01-02,1.5,2.5,0"),
    (8, "a", 8, "   "),
    (9, "a", 9, ""),
    (10, "a", 10, None),
    (11, "a", 11, "event_date,lat,lon,fatalities,note"),
    (12, "a", 12, ' 2024-01-02 23:59:59 , -90 ,+180.0,2.0,'),
    (13, "a", 13, '"2024-01-02T24:00",1e1,.5,-1,y'),
    (14, "b", 1, "note;event_date;lon;lat;fatalities"),
    (15, "b", 2, ";2024-01-02T05:06;1;2;3"),
    (16, "b", 3, "x;2024-01-02  05:06;NaN;2;1.5"),
    (17, "c", 2, "no header here"),
    (18, None, 3, "nor here"),
    (19, "d", 1, "event_date\tlat\tlon\tfatalities"),
    (20, "d", 2, '2024-01-02\t"1"\t2\t""'),
    (21, "d", 3, "2024-01-02\t1\t2\t3\n"),
    (22, "a", 22, "0000-01-01,1,2,-0,z"),
    (24, "e", 1, "a,b"),
    (25, "e", 2, "1,2"),
    (26, "e", 3, "1,2,3"),
    (23, "a", 23, '2024-01-02,1,2,3,"' + 'a""' * 40000 + '"'),
]


def _fields(line, sep):
    """Reference reading of a line: a list of fields, or None where the quoting is broken."""
    out, k = [], 0
    while True:
        if line[k : k + 1] == '"':
            j = k + 1
            while True:
                j = line.find('"', j)
                if j < 0:
                    return None
                if line[j + 1 : j + 2] == '"':
                    j += 2
                    continue
                break
            out.append(line[k + 1 : j].replace('""', '"'))
            k = j + 1
            if k < len(line) and line[k] != sep:
                return None
        else:
            j = line.find(sep, k)
            j = len(line) if j < 0 else j
            if '"' in line[k:j]:
                return None
            out.append(line[k:j])
            k = j
        if k >= len(line):
            return out
        k += 1


def _bad(name, text):
    text = text.strip(" ")
    if name == "event_date":
        m = re.fullmatch(r"([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?)?", text)
        try:
            dt.date(*map(int, m.groups()[:3]))
            return any(int(v or 0) > top for v, top in zip(m.groups()[3:], (23, 59, 59)))
        except (AttributeError, ValueError):
            return True
    if not re.fullmatch(r"[+-]?[0-9]+(\.[0-9]+)?", text):
        return True
    v = float(text)
    return v < 0 or v != int(v) if name == "fatalities" else abs(v) > (90 if name == "lat" else 180)


def test_lines_and_rows_equal_brute_force(spark):
    rows = [(1, "2024-01-02", 1.0, 2.0, 3), (2, "x", float("nan"), float("inf"), -1), (3, None, None, None, None), (4, " 2024-01-02T03:04 ", 90.00001, -180.0, 0)]
    lines = spark.createDataFrame(LINES, "line_id bigint, file_name string, line_no int, raw_line string")
    small = spark.createDataFrame([(*r, 0.5) for r in rows], "row_id bigint, event_date string, lat double, lon double, fatalities bigint, number double")
    checked = malformed.check_records(lines, small)
    want, good = set(), set()
    heads = {f: (next(s for s in "\t;," if s in raw), raw.lstrip("﻿")) for _, f, n, raw in LINES if n == 1}
    for i, f, n, raw in LINES:
        if n == 1 or raw is None or not raw.strip(" "):
            continue
        sep, head = heads.get(f, (",", None))
        got = _fields(raw, sep)
        if got is None:
            want.add(("acled_raw", i, "quoting"))
        elif head is None or len(got) != len(head.split(sep)):
            want.add(("acled_raw", i, "columns"))
        else:
            bad = {("acled_raw", i, c) for c, t in zip(head.split(sep), got) if c not in ("note", "a", "b") and _bad(c, t)}
            want |= bad
            good |= set() if bad else {("acled_raw", i)}
    want |= {("acled_small", 2, c) for c in ("event_date", "lat", "lon", "fatalities")} | {("acled_small", 3, c) for c in ("event_date", "lat", "lon", "fatalities")} | {("acled_small", 4, "lat")}
    assert {tuple(r) for r in checked.errors.collect()} == want
    clean = {(r["origin"], r["row_key"]): r for r in checked.clean.collect()}
    assert set(clean) == good | {("acled_small", 1)}
    assert tuple(clean["acled_raw", 25])[2:] == (None,) * 4
    bad = {k[:2] for k in want}
    assert {tuple(r) for r in checked.counts.collect()} == {(o, len([k for k in {*bad, *clean} if k[0] == o]), len([k for k in bad if k[0] == o]), len([k for k in clean if k[0] == o])) for o in ("acled_raw", "acled_small")}
    r = clean["acled_raw", 12]
    assert (r["event_date"], r["lat"], r["lon"], r["fatalities"]) == (dt.date(2024, 1, 2), -90.0, 180.0, 2)


def test_empty_tables(spark):
    lines = spark.createDataFrame([], "line_id bigint, file_name string, line_no int, raw_line string")
    small = spark.createDataFrame([], "row_id bigint, event_date string, lat double, lon double, fatalities bigint")
    checked = malformed.check_records(lines, small)
    assert checked.errors.count() == 0 and checked.clean.count() == 0 and malformed.error_rows(checked.errors).count() == 0


def test_well_formed_lines_agree_with_the_csv_module():
    for i, f, n, raw in LINES:
        if f == "a" and raw and n > 1 and (got := _fields(raw, ",")) is not None:
            assert got == next(csv.reader(io.StringIO(raw), strict=True))
