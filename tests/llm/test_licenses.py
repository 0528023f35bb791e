import random
import re

import pytest

from semiweave.llm import licenses
from semiweave.llm.licenses import TEMPLATES, bands_for, scan_licenses


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def runs(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, templates=TEMPLATES, containment=0.8):
    out = set()
    for doc, text in rows:
        own = words(text)
        for license_id, variant, t in templates:
            w = words(t)
            k = min(5, len(w))
            s = runs(w, k)
            share = len(s & runs(own, k)) / len(s)
            if share >= containment - 1e-12:
                out.add((doc, license_id, variant, len(s), share))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice("the of and license software copyright notice with a in is rights".split()) for _ in range(n))
    out = []
    for doc in range(150):
        parts = [say(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            w = re.split(r"\s+", rng.choice(TEMPLATES)[2].upper() if rng.random() < 0.3 else rng.choice(TEMPLATES)[2])
            for _ in range(rng.choice((0, 0, 1, 2, 6))):
                w[rng.randrange(len(w))] = rng.choice(["the", "Ähnlich", "--"])
            parts += [rng.choice(("\n", " ", "\n * ")).join(w), say(rng.randrange(0, 60))]
        out.append((doc, " ".join(parts)))
    out += [(200, None), (201, ""), (202, "All rights reserved"), (None, TEMPLATES[0][2]), (203, TEMPLATES[0][2]), (203, TEMPLATES[0][2]), (203, TEMPLATES[2][2])]
    return out + [(204, say(20000) + " " + TEMPLATES[3][2] + " " + say(500)), (205, " ".join(t for _, _, t in TEMPLATES))]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_equals_brute_force(spark, rows, limit, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_SHINGLES", limit)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, level int").repartition(3)
    got = sorted(((r.doc_id, r.license_id, r.variant, r.n_shingles, r.containment) for r in scan_licenses(df).collect()), key=str)
    assert got == brute(rows)


def test_settings_and_empty(spark, rows):
    least = 0.8 / 4 / (1 + 0.2 / 4)
    assert 1 - (1 - least) ** bands_for(0.8, 0.9999) >= 0.9999
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert scan_licenses(df.limit(0)).count() == 0
    assert scan_licenses(df, [("x", "y", "software copyright notice")]).count() == len(brute(rows, [("x", "y", "software copyright notice")]))
    assert scan_licenses(df, []).count() == 0


def test_bands_retrieve(spark, rows, monkeypatch):
    """With a single band some templates are missed, and then not reported, however much of them a text holds."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(licenses, "bands_for", lambda *a: 1)
    got = {(r.doc_id, r.license_id, r.variant) for r in scan_licenses(df).collect()}
    every = {x[:3] for x in brute(rows)}
    assert got < every and len(got) > len(every) / 5


def test_templates_of_files(spark, tmp_path):
    (tmp_path / "own-1.0.txt").write_text(" ".join(f"word{k}" for k in range(3000)))
    (tmp_path / "empty.txt").write_text("")
    docs = spark.createDataFrame([(1, "before " + " ".join(f"WORD{k}," for k in range(100, 3000)) + " after"), (2, " ".join(f"word{k}" for k in range(0, 3000, 2)))], "doc_id long, text string")
    found = scan_licenses(docs, licenses.read_templates(spark, f"file://{tmp_path}")).collect()
    assert [(r.doc_id, r.license_id, r.variant, r.n_shingles) for r in found] == [(1, "own-1.0", "full", 2996)]
