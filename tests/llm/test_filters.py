"""Line dedup, quality rules and URL filters against brute force."""

import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from framegauge.llm.host_quality import host_quality, host_verdicts, quality_measures
from framegauge.llm.line_dedup import line_dedup
from framegauge.llm.url_filters import entry_pattern, temporal_url_filter, unmatchable_entries

SPACE = r"[\x20\x09-\x0D]+"


def words_of(text):
    return [w for w in re.split(SPACE, text or "") if w]


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_line_dedup(rows):
    """Rows of (id, text), ids unique or rows equal."""
    seen, lines = set(), []
    for i, t in sorted(set(r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        for k, line in enumerate(t.split("\n")):
            lines.append((i, k, tuple(words_of(line))))
    earlier = []
    gone = defaultdict(set)
    for i, k, w in lines:
        if w:
            if w in seen or len(w) >= 10 and any(within_one(w, e) for e in earlier if abs(len(e) - len(w)) <= 1 and len(e) >= 10):
                gone[i].add(k)
            if w not in seen:
                seen.add(w)
                earlier.append(w)
    return sorted(((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]),
                    0 if t is None else len(t.split("\n")), len(gone[i]) if t is not None else 0) for i, t in rows), key=str)


def test_line_dedup(spark):
    choice = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[choice.choice(vocabulary) for _ in range(choice.choice([3, 5, 9, 10, 11, 12, 25]))] for _ in range(25)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(choice.randint(0, 6)):
            line = list(choice.choice(bases))
            for _ in range(choice.choice([0, 0, 1, 1, 2])):
                at, kind = choice.randrange(len(line)), choice.randrange(3)
                line[at:at + (kind != 0)] = [] if kind == 2 else [choice.choice(vocabulary)]
                line = line or ["x"]
            lines.append(choice.choice([" ", "\t", "  "]).join(line))
        rows.append((i, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "\n".join(" ".join(b) for b in bases)), (503, "\n".join(" ".join(b) for b in bases)),
             (None, " ".join(bases[3]) + "\nanother line of some five words"), (504, " ".join(f"v{i}" for i in range(3000))),
             (505, " ".join("edited" if i == 1700 else f"v{i}" for i in range(3000)))]
    docs = spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id bigint, text string, source string, n_lines int").repartition(5)
    got = line_dedup(docs).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=str) == plain_line_dedup(rows)
    assert line_dedup(docs.limit(0)).count() == 0


def plain_measures(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    covered = {p for places in at.values() if len(places) > 1 for i in places for p in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


TEXTS = [None, "", " \n\r\x0b", "a", "a a a a", "a b c a b c", "a b c\na b c\n\n a b c", "x y é 🙂🙂 #$%", "the " * 120,
         " ".join(f"w{i % 37}" for i in range(300)), " ".join(f"w{i}" for i in range(30_000)), "A # B | C < D\n" * 40, "\x1c odd \x85 spaces　"]


def test_quality_measures(spark):
    docs = spark.createDataFrame([(i, t, "h", -1) for i, t in enumerate(TEXTS)] * 2, "doc_id bigint, text string, source string, n_words int")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for r in quality_measures(docs).collect():
        assert tuple(r[c] for c in columns) == plain_measures(TEXTS[r["doc_id"]]), r["doc_id"]


def test_hosts(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good, "fine") for i in range(60)] + [(100 + i, "short", "bad") for i in range(40)] + [(200, good, "bad"), (201, good, None)]
    rows += [(300, "short", "single"), (301, good, "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {r["doc_id"]: (r["kept"], r["host_rejected"]) for r in host_quality(docs).collect()}
    assert kept[0] == (True, False) and kept[200] == (False, True) and kept[201] == (True, False) and kept[301] == (True, False)
    assert kept[100] == (False, True) and len(kept) == len(rows)
    rates = {r["host"]: r["short_rate"] for r in host_verdicts(quality_measures(docs)).collect()}
    overall = 41 / 103
    # Few documents say little about a host: its rate lies between its own and that of all.
    assert overall < rates["single"] < 1 and 0 < rates["other"] < overall and rates["bad"] > 0.9 and rates["fine"] < 0.05
    assert host_quality(docs.limit(0)).count() == 0


def plain_verdict(url, t, entries):
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    host = re.sub(r"^www\.|\.+$", "", m[1].lower()) if m else ""
    if not host or t is None:
        return "none", None
    labels = host.split(".")
    patterns = {".".join(labels[i:]) for i in range(max(1, len(labels) - 1))}
    if section := re.match(r"^[^:]*://[^/?#]*/([^/?#]+)", url):
        patterns.add(f"{host}/{section[1]}")
    best = None
    for p in patterns:
        for kind in ("allow", "block"):
            log = sorted((at, action) for q, k, action, at in entries if (q, k) == (p, kind) and at is not None and at <= t)
            if log and log[-1][1] == "add":
                best = max(best or ("",), ("/" in p, len(p), p, kind == "allow")) if best else ("/" in p, len(p), p, kind == "allow")
    return ("none", None) if best is None else ("allow" if best[3] else "block", best[2])


def test_url_filter(spark):
    choice = random.Random(8)
    start = datetime(2024, 3, 1)
    hosts = ["a.example.com", "example.com", "b.c.example.com", "localhost", "x.org", "example.com/en", "a.example.com/en"]
    moment = lambda: start + timedelta(hours=choice.randint(0, 24 * 12))
    entries = [(choice.choice(hosts), choice.choice(["allow", "block"]), choice.choice(["add", "add", "remove"]), moment()) for _ in range(120)]
    entries += entries[:20] + [(None, "block", "add", start), ("x.org", "other", "add", start), ("x.org", "block", "add", None)]
    urls = ["https://a.example.com/en/1", "http://WWW.Example.com.:80/en?q#f", "ftp://u:p@b.c.example.com", "http://localhost/x", "x.org/no/scheme",
            "http://x.org#y", "", None, "http://" + "long." * 60 + "org/", "https://b.c.example.com/de"]
    captures = [(i, choice.choice(urls), choice.choice([moment(), moment(), None]), "k") for i in range(400)]
    captures += captures[:30]
    got = temporal_url_filter(
        spark.createDataFrame(captures, "page_id bigint, url string, fetched_at timestamp, verdict string").repartition(4),
        spark.createDataFrame(entries, "pattern string, kind string, action string, at timestamp")).collect()
    want = sorted((i, *plain_verdict(u if u is None or len(u) < 300 else None, t, entries)) for i, u, t, _ in captures)
    assert sorted((r["page_id"], r["verdict"], r["matched"]) for r in got) == want
    assert all(r["kept"] == (r["verdict"] != "block") for r in got) and {w[1] for w in want} == {"none", "allow", "block"}


@pytest.mark.parametrize("captures, entries", [(0, 5), (5, 0)])
def test_url_filter_of_nothing(spark, captures, entries):
    c = spark.createDataFrame([(1, "http://x.org/", datetime(2024, 1, 2))] * captures, "page_id bigint, url string, fetched_at timestamp")
    e = spark.createDataFrame([("x.org", "block", "add", datetime(2024, 1, 1))] * entries, "pattern string, kind string, action string, at timestamp")
    assert [r["verdict"] for r in temporal_url_filter(c, e).collect()] == ["none"] * captures


def test_columns_of_any_name(spark):
    text = "one two three four five"
    docs = spark.createDataFrame([(1, text, "h", "w", "g", 3, 4)], "doc_id bigint, text string, source string, __words string, __host string, dropped int, value int")
    row = host_quality(docs).first()
    assert (row["__words"], row["__host"], row["dropped"], row["value"], row["n_words"]) == ("w", "g", 3, 4, 5)
    row = line_dedup(docs).first()
    assert (row["text"], row["dropped"], row["value"], row["n_lines"]) == (text, 3, 4, 1)
    at = datetime(2024, 1, 2)
    pages = spark.createDataFrame([("http://www.b.com/", at, 1, 2)], "url string, fetched_at timestamp, best int, u int")
    entries = spark.createDataFrame([("www.B.com.", "block", "add", datetime(2024, 1, 1))], "pattern string, kind string, action string, at timestamp")
    row = temporal_url_filter(pages, entries).first()
    assert (row["best"], row["u"], row["matched"], row["verdict"]) == (1, 2, "b.com", "block")


def test_entries_as_captures_are_matched(spark):
    cases = {"Example.com": "example.com", "www.example.com": "example.com", "https://u@Example.com:80/A/": "example.com/A", "example.com./a?x": "example.com/a",
             "example.com/": "example.com", "a.com/x/y": None, "": None, "/x": None}
    rows = [(p, "block", "add", datetime(2024, 1, 1)) for p in cases]
    entries = spark.createDataFrame(rows + [("c.com", "?", "add", None)], "pattern string, kind string, action string, at timestamp")
    assert {r["pattern"]: r["e"] for r in entries.where("kind = 'block'").withColumn("e", entry_pattern(F.col("pattern"))).collect()} == cases
    assert {r["pattern"] for r in unmatchable_entries(entries).collect()} == {p for p, e in cases.items() if e is None} | {"c.com"}
