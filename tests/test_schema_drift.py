"""Schema drift against a brute-force reading of the lines."""

import json
import random
from collections import Counter, defaultdict

from almagre.operators.schema_drift import SAME_CONTENT, drift, named_values, one_table

SCHEMA = "feed string, file_no int, line_no int, delivered timestamp_ntz, payload string, type string, ord int"


def _lines(spark, files):
    """``files``: (feed, file_no, [payload or object])."""
    rows = [
        (feed, n, i, None, p if isinstance(p, str) or p is None else json.dumps(p), "clash", 1)
        for feed, n, payloads in files
        for i, p in enumerate(payloads)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def _kind(v):
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else {str: "string", list: "array", dict: "object"}[type(v)]


def _brute(files):
    out, feeds = set(), defaultdict(list)
    for feed, n, payloads in files:
        feeds[feed].append((n, payloads))
    for feed, own in feeds.items():
        before = None
        for n, payloads in sorted(own):
            kinds, content = defaultdict(Counter), defaultdict(lambda: defaultdict(set))
            for p in payloads:
                for k, v in p.items():
                    kinds[k]
                    if v is not None:
                        kinds[k][_kind(v)] += 1
                        content[k][p["id"]].add(v if isinstance(v, str) else json.dumps(v))
            renamed = {}
            if before:
                types, old = before
                new, gone, cand = set(kinds) - set(types), set(types) - set(kinds), []
                for b in gone:
                    for a in new:
                        both = set(old[b]) & set(content[a])
                        same = sum(bool(old[b][i] & content[a][i]) for i in both)
                        if both and same >= SAME_CONTENT * len(both):
                            cand.append((-same / len(both), -same, b, a))
                for *_, b, a in sorted(cand):
                    if b in gone and a in new:
                        gone.discard(b)
                        new.discard(a)
                        renamed[a] = b
                        out.add((feed, n, "renamed", b, a))
                out |= {(feed, n, "added", a, "") for a in new} | {(feed, n, "removed", b, "") for b in gone}
            now = {}
            for k, c in kinds.items():
                was = before and before[0].get(renamed.get(k, k))
                now[k] = c.most_common(1)[0][0] if c else was
                if was and now[k] != was:
                    out.add((feed, n, "retyped", k, ""))
            before = now, content
    return out


def _log(spark, files):
    return {tuple(r) for r in drift(_lines(spark, files))[2].collect()}


def test_random_files(spark):
    rnd, files = random.Random(7), []
    for feed in ("a", "b"):
        names, kinds = {"x": "x", "y": "y", "z": "z"}, {"x": 0, "y": 0, "z": 0}
        for n in range(1, 12):
            for k in list(names):
                r = rnd.random()
                if r < 0.1:
                    names[k] = None if names[k] else k
                elif r < 0.25 and names[k]:
                    names[k] = f"{k}{n}"
                elif r < 0.35:
                    kinds[k] = 1 - kinds[k]
            lines = []
            for i in range(12):
                own = {"id": f"{feed}{i}"}
                for k, name in names.items():
                    if name:
                        own[name] = None if rnd.random() < 0.1 else f"{k}-{i}" if not kinds[k] else [f"{k}-{i}"]
                lines.append(own)
            files.append((feed, n, lines + lines[:1]))
    assert _log(spark, files) == _brute(files)


def test_case_nulls_and_types_kept(spark):
    files = [
        ("a", 1, [{"id": "1", "Title": "t", "n": 1}, {"id": "2", "Title": "u", "n": 2}]),
        ("a", 2, [{"id": "1", "title": "t", "n": None}, {"id": "2", "title": "u", "n": None}]),
        ("a", 5, [{"id": "1", "title": None, "n": "x"}]),
    ]
    assert _log(spark, files) == _brute(files) == {("a", 2, "renamed", "Title", "title"), ("a", 5, "retyped", "n", "")}


def test_bad_lines_and_empty_table(spark):
    assert _log(spark, []) == set()
    files = [("a", 1, ["{broken", "[1]", None, "", '"text"', {"id": "1", "x": "v" * 50_000}]), ("a", 2, [{"id": None, "y": 1}, {"y": 2}])]
    log = _log(spark, files)
    assert ("a", 2, "removed", "x", "") in log and ("a", 2, "added", "y", "") in log


def test_values_stand_under_first_names(spark):
    files = [("a", 1, [{"id": "1", "x": "t"}]), ("a", 2, [{"id": "1", "y": "t"}]), ("a", 3, [{"id": "1", "z": "t"}]), ("a", 4, [{"id": "1", "z": 5}])]
    got = {(r.file_no, r.name, r.type, r.value, r.fits) for r in named_values(_lines(spark, files)).collect() if r.name != "id"}
    assert got == {(1, "x", "string", "t", True), (2, "x", "string", "t", True), (3, "x", "string", "t", True), (4, "x", "string", "5", True)}


def test_one_table_is_typed(spark):
    more = [{"id": str(i), "x": i, "who": ["p"]} for i in range(3, 8)]
    files = [
        ("a", 1, [{"id": "1", "x": 1, "ok": True, "who": ["p", "q"], "o": {"k": 1}}, {"id": "2", "x": 2.5, "ok": None, "who": [], "o": {}}, *more]),
        ("a", 2, [{"id": "1", "y": 1, "ok": False, "who": "p", "o": "k"}, {"id": "2", "y": "many", "o": {}}, {"id": "9", "o": {}}, "{broken", None] + [{**m, "y": m["x"], "x": m["x"]} for m in more]),
        ("b", 1, [{"id": "3", "X": "text"}]),
    ]
    for line in files[1][2][5:]:
        del line["x"]
    df = one_table(_lines(spark, files))
    assert df.schema.simpleString()[7:-1].split(",")[3:] == ["X:string", "id:string", "o:string", "ok:boolean", "who:array<string>", "x_2:double"]
    got = {(r.feed, r.file_no, r.line_no): (r.id, r.x_2, r.ok, r.who, r.o) for r in df.collect()}
    assert len(got) == 18
    assert [got["a", 1, i] for i in (0, 1, 2)] == [("1", 1.0, True, ["p", "q"], '{"k":1}'), ("2", 2.5, None, [], "{}"), ("3", 3.0, None, ["p"], None)]
    assert [got["a", 2, i] for i in (0, 1, 3, 4, 5)] == [("1", 1.0, False, None, None), ("2", None, None, None, "{}"), (None,) * 5, (None,) * 5, ("3", 3.0, None, ["p"], None)]
    assert got["b", 1, 0] == ("3", None, None, None, None)
    unfit = {(r.name, r.value) for r in named_values(_lines(spark, files)).where("not fits").collect()}
    assert unfit == {("x", "many"), ("who", "p"), ("o", "k")}
    assert one_table(_lines(spark, [])).count() == 0
