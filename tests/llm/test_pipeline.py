"""The five stages against brute-force versions, each on what the stage before it wrote."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))
pipeline = pytest.importorskip("corpus_pipeline")

from carepath.llm import language, line_dedup, mixing  # noqa: E402
from tests.llm.test_llm_operators import brute, prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id string, row int"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(11)
    menu = "All pages of this site carry this line"
    data = []
    for i in range(240):
        lines = [prose(r, r.randint(15, 60), 300 if i % 2 else 500) for _ in range(r.randint(1, 3))]
        if i % 3 == 0:
            lines.insert(0, menu)
        data.append((i, "\n".join(lines), "aa" if i % 2 else "bb", f"s{i % 5}" if i % 11 else None, 1))
    base = data[7][1].split()
    for k in range(12):  # near copies and exact ones
        words = base[:]
        words[k % 4] = f"changed{k}"
        data.append((1000 + k, " ".join(words), "aa", "s1", 1))
    data += [(2000 + k, data[3][1], "aa", "s3", 1) for k in range(5)]
    data += [(3000, None, None, "s1", None), (3001, "", "aa", None, 0), (3002, "12 34 !!", None, "s2", 8), (None, prose(r, 80), "aa", "s2", 1), (3003, prose(r, 30, 500) * 200, "bb", "s4", 1), data[20]]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(*d, "x", 5) for d in data], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def rows_of(df):
    return Counter((x["doc_id"], x["text"], x["source"], x["n_chars"]) for x in df.collect())


def cleaned(rows):
    """Line dedup by plain counting."""
    pages, hits = defaultdict(set), defaultdict(set)
    for _, t, h, _ in rows:
        pages[h].add(t or "")
        for line in {x.strip() for x in (t or "").split("\n")} - {""}:
            hits[h, line].add(t)
    out = Counter()
    for (i, t, h, n), times in rows.items():
        stay = [x for x in (t or "").split("\n") if not (len(hits[h, x.strip()]) >= pipeline.SITE_LINES["fewest_hits"] and len(hits[h, x.strip()]) > line_dedup.RATIO * len(pages[h]))]
        new = None if t is None else "\n".join(stay)
        out[i, new, h, n if new == t else len(new)] += times
    return out


def mixed(rows):
    """How often each row is taken: keys in order, whole epochs first."""
    by, out = defaultdict(list), Counter()
    for (i, t, h, n), times in rows.items():
        marks = sum(c in "#*$%&|<>" for c in t or "")
        q = 1 - 0.5 * min(1.0, 8 * marks / max(1, len(t or "")))
        body = hashlib.md5((t or "").encode()).hexdigest()
        for copy in range(times):
            u = (int(hashlib.md5(f"{mixing.SEED}|{'' if i is None else i}|{body}|{copy}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            by[h].append((-math.log(u) / q, str(i), len((t or "").split()), (i, t, h, n)))
    goal = mixing.targets({h: sum(x[2] for x in xs) for h, xs in by.items()})
    for h, xs in by.items():
        size, before = sum(x[2] for x in xs), 0
        epochs = min(3, int(goal[h] // size)) if size else 0
        rest = goal[h] - epochs * size if epochs < 3 else 0
        for _, _, n, row in sorted(xs, key=lambda x: x[:2]):
            out[row] += epochs + (before < rest and before + n / 2 <= rest)
            before += n
    return +out


def test_stages_and_run_against_brute_force(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    assert 4 <= len(pipeline.STAGES) <= 5
    state, frames = docs, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        state = pipeline.stored(stage(spark, state, table), f"test-{k}")
        frames.append(state)
        assert k == len(pipeline.STAGES) - 1 or state.columns == docs.columns

    model = language.fit(docs, ~language.held_out())
    verdict = docs.withColumn("found", language.detect(model)(F.col("text"))).where("not found.rejected")
    kept = [rows_of(f) for f in frames[:4]]
    assert kept[0] == rows_of(verdict) and not any(t in (None, "", "12 34 !!") for _, t, *_ in kept[0])
    assert kept[1] == cleaned(kept[0]) and kept[1] != kept[0]

    flat = [x for x, n in kept[1].items() for _ in range(n)]
    component = {}
    for (i, t, *_), (_, n, c) in zip(flat, brute(flat, 5, 80), strict=True):
        component.setdefault((i, t), c if n else ("none", i, t))
    want = Counter({x: 1 for x in kept[1] if x[0] is None or component[x[0], x[1]] == x[0] or isinstance(component[x[0], x[1]], tuple)})
    assert kept[2] == want
    assert kept[3] == mixed(kept[2])

    import public_tokenizers
    from tokenizers import Tokenizer

    library, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for (i, t, *_), times in kept[3].items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            pieces[i, k // 2048, len(ids[k : k + 2048]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[k : k + 2048]))] += times
    for packed in (frames[4], pipeline.run(spark, table)):
        got = packed.collect()
        assert Counter((x["doc_id"], x["piece"], x["length"], x["ids_crc32"]) for x in got) == pieces
        at = defaultdict(int)
        for x in sorted(got, key=lambda x: (x["sequence_id"], x["offset"])):
            assert x["offset"] == at[x["sequence_id"]]
            at[x["sequence_id"]] += x["length"]
        assert max(at.values()) <= 2048


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
