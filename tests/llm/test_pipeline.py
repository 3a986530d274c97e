import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as C
from shirabe.llm import bpe, mixing, secrets, simhash, toxicity

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What every stage returns over the small tables, each reading its predecessor's rows."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for _, stage in C.STAGES:
        rows = stage(spark, out[-1], DIR)
        out.append(spark.createDataFrame(rows.collect(), rows.schema).cache())
    return out


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_columns(kept):
    assert all(df.columns == kept[0].columns for df in kept[:-1]) and [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "byte_bpe"]


def test_toxic_documents_go(spark, kept):
    net = toxicity.fitted(kept[0], spark.read.parquet(f"{DIR}/labels.parquet"))
    rows = kept[0].collect()
    flags = [toxicity.score_arrow(pa.array([r.text]), net)[0][0].as_py() for r in rows]
    assert ids(kept[1]) == sorted(r.doc_id for r, f in zip(rows, flags) if not f)


def test_one_of_each_group_stays(kept):
    rows = sorted(kept[1].collect(), key=lambda r: r.doc_id)
    sig = np.stack([simhash._matrix(simhash.signatures(pa.array([r.text])))[0] for r in rows])
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            near = np.flatnonzero(np.bitwise_count(sig ^ sig[i]).sum(1) <= simhash.MOST)
            low = min(root[j] for j in near)
            if root[i] != low:
                root[i], changed = low, True
    assert ids(kept[2]) == sorted(rows[i].doc_id for i in set(root)) and len(set(root)) < len(rows)


def test_no_secret_is_left_and_nothing_else_changes(kept):
    before = {r.doc_id: r for r in kept[2].collect()}
    after = {r.doc_id: r for r in kept[3].collect()}
    assert set(before) == set(after)
    for i, b in before.items():
        spans = sorted(m.span() for p in secrets.RULES.values() for m in re.finditer(p, b.text, re.ASCII))
        t, last = b.text, []
        for a, z in spans:
            if last and a < last[-1][1]:
                last[-1][1] = max(last[-1][1], z)
            else:
                last.append([a, z])
        for a, z in reversed(last):
            t = t[:a] + secrets.MASK + t[z:]
        assert after[i].text == t and after[i].source == b.source and after[i].n_chars == (b.n_chars if t == b.text else len(t))


def test_the_mix_meets_its_quotas(kept):
    rows, out = kept[3].collect(), kept[4].collect()
    size = {r.doc_id: len(re.findall(r"[^ \t\n\r\f\v]+", r.text)) for r in rows}
    capacity, members = {}, {}
    for r in rows:
        p = "\x1f".join(sorted((f"source:{r.source}", f"lang:{r.lang}")))
        members[p] = p.split("\x1f")
        capacity[p] = capacity.get(p, 0) + size[r.doc_id]
    own = {}
    for p, ss in members.items():
        for s in ss:
            own[s] = own.get(s, 0) + capacity[p]
    flow = mixing.route(capacity, members, mixing.quotas(mixing.by_family(own), sum(capacity.values())))
    for p, f in flow.items():
        got = sum(size[r.doc_id] for r in out if "\x1f".join(sorted((f"source:{r.source}", f"lang:{r.lang}"))) == p)
        assert abs(got - sum(f.values())) <= max(size.values()) * 2
    assert {r.doc_id for r in out} <= {r.doc_id for r in rows}


def test_encoded(spark, kept):
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    tok = bpe.codec(bpe.DEFAULT_TOKENIZER).tok
    rows = kept[5].collect()
    assert ids(kept[5]) == ids(kept[4])
    assert all(r.round_trip and r.token_ids == tok.encode(texts[r.doc_id], add_special_tokens=False).ids for r in rows)
    assert sorted((r.doc_id, r.n_tokens) for r in C.run(spark, DIR).collect()) == sorted((r.doc_id, r.n_tokens) for r in rows)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, `__k1` int, mix_source string"


def folder(spark, where, rows):
    spark.createDataFrame([(i, t, lang, source, len(t) if t is not None else None, "own", 7, "mine") for i, t, lang, source in rows], SCHEMA).coalesce(1).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_odd_documents(spark, tmp_path):
    word = lambda k, n: " ".join(f"{k}w{i}" for i in range(n))
    long = "long " + word("l", 60_000) + " api_key = " + "K9" * 500
    rows = [
        (1, word("a", 40), "en", "web"), (1, word("a", 40), "en", "web"), (1, word("b", 40), "en", "web"), (2, word("a", 40), "en", "web"), (3, None, "en", "web"), (4, "", "en", "web"), (5, "", "de", "book"),
        (6, long, "en", "book"), (7, word("c", 30), None, "web"), (8, word("d", 30), "de", None), (9, word("e", 30), None, None), (None, word("f", 30), "de", "web"), (None, None, None, None),
    ]
    got = C.run(spark, folder(spark, tmp_path, rows)).collect()
    assert {r.doc_id for r in got} - {3, 4, None} == {1, 6, 7, 8} or {r.doc_id for r in got} - {3, 4, None} < {1, 6, 7, 8}
    assert 9 not in {r.doc_id for r in got} and {r.n_tokens_in for r in got} == {"own"} and {r["__k1"] for r in got} == {7} and {r.mix_source for r in got} == {"mine"}
    assert all(r.round_trip is not False and (r.token_ids is None) == (r.doc_id == 3 or r.n_tokens is None) for r in got)
    ids = bpe.codec(bpe.DEFAULT_TOKENIZER).tok.decode([i for r in got if r.doc_id == 6 for i in r.token_ids][:400_000])
    assert "K9K9" not in ids
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = C.drop_near_duplicates(spark, C.reject_toxic(spark, docs, str(tmp_path)), str(tmp_path))
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert left == sorted(((i, t) for i, t in {(i, t) for i, t, *_ in rows} - {(2, word("a", 40)), (5, "")}), key=repr)


def test_no_documents(spark, tmp_path):
    where = folder(spark, tmp_path, [])
    got = C.run(spark, where)
    assert got.count() == 0 and "token_ids" in got.columns


def test_a_run_leaves_one_table(spark, tmp_path):
    import os

    from shirabe.llm import common

    root = common.shared_dir(spark).removeprefix("file://") + "/shirabe"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with common.scratch(spark):
        assert C.run(spark, DIR).count() > 0
        assert [x.split("-")[1] for x in set(os.listdir(root)) - before] == ["mixing"]
    assert set(os.listdir(root)) == before


def test_planted_secrets_leave_no_character(spark, tmp_path):
    """Whole keys, long tokens: what is left is compared with the planted text, not with the rules."""
    body = "\n".join("MIIEpAIBAAKCAQEA" + "Zq7" * 16 for _ in range(25))
    planted = {
        "pem": f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----", "cut pem": f"-----BEGIN PRIVATE KEY-----\n{body}", "jwt": "eyJ" + "Zq7" * 400 + ".eyJ" + "Zq7" * 400 + "." + "Zq7" * 20,
        "gh": "ghp_" + "Zq7" * 700, "slack": "xoxb-" + "Zq7" * 700, "sk": "sk-" + "Zq7" * 700, "password": "DB_PASSWORD=" + "Zq7" * 700, "url": "https://me:" + "Zq7" * 100 + "@host/", "stripe": "sk_live_" + "Zq7" * 700,
    }
    rows = [(i, f"before {k} \n{v}\nafter {k}", "en", "web") for i, (k, v) in enumerate(planted.items())]
    docs = spark.read.parquet(folder(spark, tmp_path, rows) + "/documents.parquet")
    for r in C.blank_secrets(spark, docs, str(tmp_path)).collect():
        kind = list(planted)[r.doc_id]
        assert "Zq7" not in r.text and "MIIE" not in r.text, kind
        assert r.text.startswith(f"before {kind} \n") and r.text.endswith(f"after {kind}") and r.n_chars == len(r.text)
