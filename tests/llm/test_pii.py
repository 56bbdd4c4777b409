import itertools

import numpy as np
import pytest

from vellum.llm import crf, pii
from vellum.llm.pii_cues import cue_spans
from vellum.sources.tables import table

TEXTS = [
    ("Questions about the lists go to Dr. Oliver H. DUNEMOOR, tel. +44 20 7946 0584.", [("name", "Oliver H. DUNEMOOR"), ("phone", "+44 20 7946 0584")]),
    ("A reader, Mrs Nora Wesishaw, sent a copy (reply to w.tchat＠archiv.test). Shelf mark F-9715/24/3395.", [("name", "Nora Wesishaw"), ("email", "w.tchat＠archiv.test")]),
    ("The courier left the films with Quenumoor, Simon, PO Box 69, Ormsbrook. Entry 774022903366 names nobody.", [("name", "Quenumoor, Simon"), ("address", "PO Box 69, Ormsbrook")]),
    ("Заявитель: Ирина Горслишенко\nПаспорт: 0005, номер 986241\nТел.: 8 812 0426491\nАдрес: ул. Влулсолинская, д. 88, кв. 93\nДата: 22.07.2020", [("name", "Ирина Горслишенко"), ("id_number", "0005, номер 986241"), ("phone", "8 812 0426491"), ("address", "ул. Влулсолинская, д. 88, кв. 93")]),
    ("Въ роли принцессы Ильды дебютировалъ г. Морколинъ 2-й. Театръ Большой Ямской далъ «Лунный фонарь».", [("name", "Морколинъ")]),
    ("Anschrift Am Notenstecherplatz 121, Wendelau\nAusweis L0RM4V664\nE-Mail edwin-v at reading-room dot example", [("address", "Am Notenstecherplatz 121, Wendelau"), ("id_number", "L0RM4V664"), ("email", "edwin-v at reading-room dot example")]),
    ("Mon numéro d'identité est le 1 98 07 00 317 066 51. J'habite 78, rue des Vanniers, 00873 Vaucreuil.", [("id_number", "1 98 07 00 317 066 51"), ("address", "78, rue des Vanniers, 00873 Vaucreuil")]),
    ("The reading room asked for an identity number; mine is QQ717188B. On page 45 of the record 4456461446 nothing stands.", [("id_number", "QQ717188B")]),
    ("🎭🎭 Yours faithfully, Simon S. Quenicombe", [("name", "Simon S. Quenicombe")]),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = table(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text").where("length(text) > 0").orderBy("doc_id").collect()
    return [r.text for r in rows]


@pytest.fixture(scope="module")
def field(corpus):
    """Fitted on two documents of three; the third is held out."""
    return pii.fit_texts([t for i, t in enumerate(corpus) if i % 3])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(TEXTS)] + [(100, None, "x"), (101, "", "x"), (102, "  \n", "x"), (0, TEXTS[0][0], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, kind string")


def test_spans(docs, field):
    got = {}
    for r in pii.find_personal(docs, "doc_id", "text", field).collect():
        got.setdefault(r.doc_id, []).append((r.char_start, r.kind, TEXTS[r.doc_id][0][r.char_start : r.char_end]))
    want = {i: sorted((k, s) for k, s in w) for i, (_, w) in enumerate(TEXTS)}
    hits = sum(len({(k, s) for _, k, s in got.get(i, [])} & set(w)) for i, w in want.items())
    told = sum(map(len, got.values()))
    assert set(got) <= set(want)
    assert hits >= 0.9 * sum(map(len, want.values())) and hits >= 0.9 * told


def test_redacted(docs, field):
    got = {r.doc_id: r.redacted for r in pii.redact(docs, "doc_id", "text", field).collect()}
    assert got[0] == "Questions about the lists go to Dr. [NAME], tel. [PHONE]."
    assert got[100] is None and got[101] == "" and got[102] == "  \n"


def test_held_out_accuracy(corpus, field):
    held = corpus[::3]
    got = pii.label(field, held)
    want = [set(cue_spans(t)) for t in held]
    both = sum(len(w & set(g)) for w, g in zip(want, got))
    assert both >= 0.97 * sum(map(len, want)) and both >= 0.97 * sum(map(len, got))


def test_the_model_decides(corpus, field):
    """Names come from the weights: without them nothing is a name, patterns or not."""
    empty = pii.fit_texts(["Nothing at all."] * 5)
    assert not any(pii.label(empty, [t for t, _ in TEXTS]))
    differ = sum(set(g) != set(cue_spans(t)) for g, t in zip(pii.label(field, corpus), corpus))
    assert differ > 0


def named(field, text):
    return [text[a:b] for k, a, b in pii.label(field, [text])[0] if k == "name"]


def test_skip_edges_carry_a_bare_surname(field):
    text = "Asked Hugh Quenothorp about it. The receipts line is blank. Letters of Quenothorp were lost."
    assert named(field, text) == ["Hugh Quenothorp", "Quenothorp"]
    alone = crf.Field()
    alone.__dict__.update(field.__dict__, skip=field.skip * 0)
    assert named(alone, text) == ["Hugh Quenothorp"]


def test_skip_edges_drop_an_isolated_answer(field):
    block = crf.read_block(["Velithorp one. Velithorp two. Velithorp three. Velithorp four."])
    own = field.potentials(block)
    tokens = block.groups[0]
    own[tokens] = 0.0
    own[tokens, 0] = 3.0
    own[tokens[0], 0], own[tokens[0], crf.NAMES[0]] = 0.0, 3.0
    own[np.setdiff1d(np.arange(len(own)), tokens), 0] += 20
    near = field.marginals(own, block.chains)
    assert near[tokens[0], crf.NAMES].sum() > 0.5
    told = field._messages(block, own, near)
    own[:, crf.NAMES] += told[:, None].astype(np.float32)
    assert field.best(own, block.chains)[tokens[0]] == 0


def brute(field, own, firsts_len):
    """Marginals and best path of one chain by all label sequences."""
    n, labels = firsts_len, range(crf.L)
    go = np.where(crf.allowed(), field.w["step"], -np.inf)
    scores = {}
    for path in itertools.product(labels, repeat=n):
        if crf.LABELS[path[0]][0] == "I":
            continue
        s = sum(own[t, y] for t, y in enumerate(path)) + sum(go[a, b] for a, b in itertools.pairwise(path))
        if s > -np.inf:
            scores[path] = s
    top = max(scores.values())
    z = sum(np.exp(s - top) for s in scores.values())
    near = np.zeros((n, crf.L))
    for path, s in scores.items():
        for t, y in enumerate(path):
            near[t, y] += np.exp(s - top) / z
    return near, max(scores, key=scores.get)


def test_passes_against_brute_force(field):
    rng = np.random.default_rng(5)
    own = rng.normal(0, 2, (7, crf.L)).astype(np.float32)
    chains = (np.array([0, 3, 6]), np.array([3, 3, 1]))
    near, best = field.marginals(own.astype(np.float64), chains), field.best(own, chains)
    for first, n in zip(*chains):
        want, path = brute(field, own[first : first + n], n)
        assert np.allclose(near[first : first + n], want, atol=1e-6)
        assert tuple(best[first : first + n]) == path


def test_long_and_empty(spark, field):
    text = "Nothing here. " * 20_000 + "For the plates, write to Clara Velemoor."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r.kind, r.char_end - r.char_start) for r in pii.find_personal(df, "doc_id", "text", field).collect()] == [("name", 14)]
    assert pii.find_personal(df.limit(0), "doc_id", "text").collect() == []
