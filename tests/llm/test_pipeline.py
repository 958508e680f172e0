"""The pipeline against a plain-Python version of its stages on a small fixture."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

import corpus_pipeline
from framegauge.llm.queries import TOKENIZER
from framegauge.llm.vocabulary import library_encoder
from test_filters import plain_line_dedup, plain_measures, words_of

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
INSULTS = ["slurring", "insults", "curses", "slur"]


def documents():
    choice = random.Random(12)
    plain = [f"word{i}" for i in range(900)]

    def prose(n):
        return " ".join(choice.choice(plain) + ("." if k % 13 == 12 else "") for k in range(n))

    rows, toxic = [], set()
    for i in range(240):
        text = prose(choice.randint(60, 150))
        if i % 5 == 0:
            words = text.split(" ")
            words[20:20] = choice.choices(INSULTS, k=5)
            text, _ = " ".join(words), toxic.add(i)
        if i % 4 == 1:
            text = "read more\n" + text + "\n\nHome | About"
        rows.append((i, text, f"host{i % 6}"))
    by_id = {r[0]: r[1] for r in rows}
    rows += [(1000 + i, by_id[1], "host1") for i in range(3)]
    # Near copies: a word among the last ones of a long line, so that lines differ by more than one word.
    for i in range(12):
        words = by_id[2 + 5 * i].split(" ")
        words[30], words[31], words[32] = "other", "words", f"here{i}"
        rows.append((2000 + i, " ".join(words), "host2"))
    rows += [(3000 + i, prose(20), "bad") for i in range(40)] + [(3100 + i, prose(80), "bad") for i in range(4)]
    rows += [(4000, None, "host1"), (4001, "", None), (4002, prose(70), None), (4003, prose(4000), "host3")]
    return [(i, t, "en", s, len(t or "")) for i, t, s in rows], toxic


def host_verdicts(rows):
    """Rows kept by the quality rules and by their hosts' shrunk failure rates."""
    failed = {}
    for i, text, source in rows:
        n, _, symbols, _, repeated, base = plain_measures(text)
        lines = [x for x in (text or "").split("\n") if words_of(x)]
        failed[i] = (base, (n < 50, repeated > n * 0.5, symbols > n * 0.1, len(lines) - len(set(lines)) > len(lines) * 0.3))
    hosts = defaultdict(list)
    for i, _, source in rows:
        if source is not None:
            hosts[source].append(failed[i][1])
    total, bad = sum(map(len, hosts.values())), set()
    for rule in range(4):
        mean = sum(f[rule] for fs in hosts.values() for f in fs) / total
        spread = sum(len(fs) * (sum(f[rule] for f in fs) / len(fs) - mean) ** 2 for fs in hosts.values())
        between = (spread - mean * (1 - mean) * (len(hosts) - 1)) / total
        strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6) if between > 0 else 1e6
        bad |= {s for s, fs in hosts.items() if (sum(f[rule] for f in fs) + mean * strength) / (len(fs) + strength) > 0.6}
    return {i for i, _, source in rows if not failed[i][0] and source not in bad}


def fingerprint(text):
    words = words_of("".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[k:k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), seed=42) >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(shingles))


def firsts(rows):
    """Smallest ids of the groups of fingerprints that differ by two bits at most."""
    prints = {i: fingerprint(t) for i, t in rows}
    left, kept = set(prints), set()
    while left:
        root = min(left)
        kept.add(root)
        waiting = [root]
        left.discard(root)
        while waiting:
            a = waiting.pop()
            near = {b for b in left if (prints[a] ^ prints[b]).bit_count() <= 2}
            left -= near
            waiting += near
    return kept


def test_stages_against_plain_python(spark, tmp_path):
    rows, toxic = documents()
    for name, data, schema in (("documents", rows, SCHEMA), ("labels", [(i, 1, int(i in toxic)) for i in range(240)], "doc_id bigint, quality int, toxic int")):
        spark.createDataFrame(data, schema).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    run = {}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name in ("toxicity", "quality rules", "line dedup", "SimHash near-dedup", "packing"):
        path = str(tmp_path / name.replace(" ", "-"))
        stage[name](spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        run[name] = docs.collect()
    kept = {name: {r["doc_id"]: r["text"] for r in found} for name, found in run.items() if name != "packing"}
    # The model decides on toxic texts (its own tests); clean ones all stay.
    gone = {r[0] for r in rows} - set(kept["toxicity"])
    assert gone <= toxic and len(gone) >= 0.6 * len(toxic)
    clean = [(r[0], r[1], r[3]) for r in rows if r[0] not in gone]
    good = host_verdicts(clean)
    assert set(kept["quality rules"]) == good and not {i for i, _, s in clean if s == "bad"} & good and 4002 in good
    lines = {i: t for i, t, *_ in plain_line_dedup([(i, t) for i, t, _ in clean if i in good])}
    assert kept["line dedup"] == lines and any("read more" not in t for i, t in lines.items() if i % 4 == 1)
    assert {r["n_chars"] - len(r["text"]) for r in run["line dedup"]} == {0}
    assert set(kept["SimHash near-dedup"]) == firsts(lines.items())
    assert kept["SimHash near-dedup"] == {i: lines[i] for i in kept["SimHash near-dedup"]}
    encode = library_encoder(TOKENIZER)
    pieces = defaultdict(list)
    for r in run["packing"]:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert set(pieces) == set(kept["SimHash near-dedup"])
    for i, found in pieces.items():
        ids = np.frombuffer(b"".join(encode(lines[i])) + (1).to_bytes(4, "little"), "<u4")
        at = 0
        for start, length, crc in sorted(found):
            assert start == at and zlib.crc32(ids[at:at + length].tobytes()) == crc
            at += length
        assert at == len(ids)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in whole) == sorted((r["doc_id"], r["start"], r["length"]) for r in run["packing"])


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
