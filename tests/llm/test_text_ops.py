"""Fill-in-middle, licence scans and alignment against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.llm import alignment, fill_middle, licenses
from foliant.llm.pieces import file_of, library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def odd_texts():
    rng = random.Random(5)
    alphabet = [*"abcXYZ é漢😀\n\t<>PSM▁'.0", "<P>", "  ", "\0", "<|endoftext|>", "<s>", "\x1c", " "]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return [*made, None, "", " ", "a", "<", "<M", "é", "x" * 200_000, "ab cd " * 40_000, "漢" * 100_000, "l'été " * 30_000]


def fim(doc_id, text):
    t = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    n, h = len(u), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:x]), "".join(u[x:y]), "".join(u[y:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle(spark, docs):
    texts = [*(r["text"] for r in docs.collect()), *odd_texts()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, "no id"), (7, texts[7]), (7, "another")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter((i, *fim(i, t)[:4], hashlib.sha256(fim(i, t)[4].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert Counter(map(tuple, fill_middle.report(df).collect())) == want
    made = fill_middle.transform(df)
    assert Counter(map(tuple, made.collect())) == Counter((i, *fim(i, t)) for i, t in rows)
    assert Counter(map(tuple, fill_middle.restore(made).collect())) == Counter((i, t or "") for i, t in rows)
    assert {r["form"] for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_fill_middle_pieces_are_bounded(spark):
    df = spark.createDataFrame([(1, "x" * 500_000 + " yz" * 50_000)], "doc_id long, text string")
    p = fill_middle.pieces(df)
    assert p.agg(F.max(F.length("piece"))).first()[0] <= fill_middle.PIECE and p.count() > 20
    plan = fill_middle.report(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_licenses_base_by_brute_force(spark, docs):
    rng = random.Random(2)
    bits = ["CC", "by", "General", "PUBLIC", "license", "all", "rights", "reserved", "lesser", "é", "x1", "nc", "-", ", ", "\n", "/", "4.0", "MIT"]
    texts = [*(r["text"] for r in docs.collect()), *("".join(rng.choice(bits) + rng.choice([" ", "  ", "-", ""]) for _ in range(rng.randint(0, 40))) for _ in range(400))]
    texts += ["general public", "license all rights", "reserved cc", "by", "all rights reserved " * 5000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in licenses.report(df).collect()}
    seen = 0
    for i, t in enumerate(texts):
        w = WORD.findall(lower(t))
        places = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
        notices = {x for p, x in licenses.NOTICES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()}
        assert notices | {x for _, x in places} == {x for x in r["labels"].split(",") if x}
        seen += len(places)
    assert seen > 5000


@pytest.mark.parametrize(
    "text,level,names,good",
    [
        ("MIT", 0.2, {"mit"}, True),
        ("GPL-3.0-only OR MIT AND Apache-2.0", 0.25, {"gpl-3.0-only", "mit", "apache-2.0"}, True),
        ("(GPL-3.0-only OR MIT) AND AGPL-3.0 */", 0.8, {"gpl-3.0-only", "mit", "agpl-3.0"}, True),
        ("GPL-2.0-or-later WITH Classpath-exception-2.0 and MPL-2.0", 0.5, {"gpl-2.0-or-later", "mpl-2.0"}, True),
        ("mit or", 0.2, {"mit"}, False),
        ("((MIT OR Foo", 0.2, {"mit", "foo"}, False),
        ("MIT or (", 0.2, {"mit"}, False),
        ("LicenseRef-own", 0.9, {"licenseref-own"}, True),
        ("MIT) or GPL-3.0", 0.2, {"mit"}, True),
    ],
)
def test_license_expressions(text, level, names, good):
    assert licenses.evaluate(text) == (level, frozenset(names), good)


def test_license_expression_without_operand():
    assert [licenses.evaluate(x) for x in ("", "or MIT", "()", "*/", "with")] == [None] * 5


def random_tree(rng, depth):
    if not depth or rng.random() < 0.3:
        name = rng.choice(["MIT", "GPL-3.0", "MPL-2.0", "AGPL-3.0", "Own-1"])
        level = licenses.level(name.lower())
        if rng.random() < 0.2:
            return f"{name} WITH Some-exception", min(level, 0.5) if level < 0.9 else level
        return name, level
    (a, x), (b, y) = random_tree(rng, depth - 1), random_tree(rng, depth - 1)
    return (f"({a}) or ({b})", min(x, y)) if rng.random() < 0.5 else (f"({a}) AND ({b})", max(x, y))


def test_license_expressions_against_trees():
    rng = random.Random(9)
    for _ in range(300):
        text, level = random_tree(rng, 4)
        assert licenses.evaluate(text)[0] == level


def test_license_tags(spark):
    texts = ["// SPDX-License-Identifier: MIT OR GPL-2.0-only\ncode", "# spdx-license-identifier = (Apache-2.0 AND\n MIT)", "License-Expression:" + " " * 3000 + "MPL-2.0", "SPDX-License-Identifier", "the SPDX License Identifier is MIT", "GNU Lesser General Public License", "x" * 5000 + " SPDX-License-Identifier: " + "(" * 2000 + "MIT" + ")" * 2000 + " AND EPL-2.0", "SPDX-License-Identifier: MIT " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.report(df).collect()}
    assert got == {0: ("gpl-2.0-only,mit", 0.2), 1: ("apache-2.0", 0.25), 2: ("mpl-2.0", 0.5), 3: ("", 0.0), 4: ("", 0.0), 5: ("gpl,lgpl", 0.5), 6: ("epl-2.0,mit", 0.5), 7: ("mit", 0.2)}
    found = licenses.find(df)
    assert {(r["doc_id"], r["labels"], r["first_word"], r["words"], r["well_formed"]) for r in found.where("doc_id in (0, 1, 5)").collect()} == {(0, "gpl-2.0-only,mit", 0, 3, True), (1, "apache-2.0", 0, 3, False), (5, "lgpl", 1, 4, True), (5, "gpl", 2, 3, True)}


def aligned_by_brute(texts):
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(file_of(alignment.A_MODEL))
    a.encode_special_tokens = True
    b = library(file_of(alignment.B_MODEL))
    letters = alignment.byte_of_letter()
    vocab = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    out, counts = [], Counter()
    for t in texts:
        x = a.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        raw = (" " + (t or "")).encode()
        if not t or b"".join(vocab[i] for i in x) != raw or b"".join(map(b_bytes, y)) != raw:
            out.append((0, 0, 0, [], ""))
            continue
        ends = lambda ids, f: [sum(len(f(i)) for i in ids[: k + 1]) for k in range(len(ids))] if len(ids) < 300 else list(running(len(f(i)) for i in ids))
        ea, eb = ends(x, vocab.__getitem__), ends(y, b_bytes)
        both = sorted(set(ea) & set(eb))
        ia, ib, groups, links = 0, 0, [], []
        for e in both:
            ja, jb = ea.index(e, ia) + 1, eb.index(e, ib) + 1
            groups.append(",".join(map(str, x[ia:ja])) + "|" + ",".join(map(str, y[ib:jb])))
            links.append((x[ja - 1], y[jb - 1]))
            ia, ib = ja, jb
        counts.update(links)
        out.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = {}
    for (_, j), n in counts.items():
        top[j] = max(top.get(j, 0), n)
    return [(na, nb, ng, len(ls), sum(counts[k] == top[k[1]] for k in ls), sum(counts[k] for k in ls), h) for na, nb, ng, ls, h in out]


def running(sizes):
    n = 0
    for s in sizes:
        n += s
        yield n


@pytest.mark.parametrize("tier", [alignment.TIER, 50, 0])
def test_alignment(spark, docs, tier):
    texts = [*(r["text"] for r in docs.collect()), *(t for t in odd_texts() if t is None or len(t) < 1000)]
    texts += [texts[5]] * 7 + [None, "", "ab cd " * 20_000, "l'été\n\n" * 15_000]
    want = aligned_by_brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.report(df, tier=tier).collect()}
    for i, x in enumerate(want):
        assert got[i] == x, (i, texts[i])
    assert sum(x[0] > 0 for x in want) > 300 and any(x[0] == 0 and t for x, t in zip(want, texts, strict=True))


def test_chunks_encode_like_whole_texts():
    from tokenizers import Tokenizer

    path_a, path_b = file_of(alignment.A_MODEL), file_of(alignment.B_MODEL)
    whole = Tokenizer.from_file(path_a)
    whole.encode_special_tokens = True
    sp = library(path_b)
    (encode_a, _), (encode_b, _) = alignment.side_a(path_a), alignment.side_b(path_b)
    rng = random.Random(1)
    alphabet = [*" \n\t\r\x0b\x1c\x85\xa0\u2003\u3000'as1.é漢😀▁\0", "'s", "  ", "\n\n", " \n", "word", "<|endoftext|>", "<s>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x3000), 32, 10, 97])) for _ in range(40)) for _ in range(2000)]
    for t in texts:
        cut = alignment._CHUNK.findall(" " + t)
        assert "".join(cut) == " " + t
        assert [i for x in encode_a(cut) for i in x] == whole.encode(" " + t, add_special_tokens=False).ids, repr(t)
        if "▁" not in t:  # which is never spelled
            assert [i for x in encode_b(cut) for i in x] == sp.encode(t), repr(t)
