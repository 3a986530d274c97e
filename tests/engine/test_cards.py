"""The card queries against their SQL, over texts in which other numbers stand beside the cards."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from shirabe import registry
from tests.oracle import DIR, TABLES, same

CARD, LONG, AMEX = "4913187196670932", "4000000000000000006", "378734493671000"
BESIDE = ("53.121.55.90", "1 2", "12", "123", "1234", "4405935324758010", "x", "-1", ".", "\n", "")
TEXTS = [a + card + gap + b for card in (CARD, "4913-1871-9667-0932", "4913 1871 9667 0932", LONG, AMEX) for a in ("", "7 ", "99 ", "tel 555-9331 ", "a", "/", "、", "😀") for gap in (" ", "  ", "-", ", ", "\n", "\t", "　") for b in BESIDE]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("cards")
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{DIR}/{t}.parquet", out / f"{t}.parquet")
    n = range(len(TEXTS))
    pq.write_table(pa.table({"doc_id": pa.array(n, pa.int64()), "text": TEXTS, "lang": [("en", "ja")[i % 2] for i in n], "source": [f"src{i % 5}" for i in n], "n_chars": pa.array(map(len, TEXTS), pa.int64())}), out / "documents.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["card_by_source", "card_findings", "findings_per_million_lines"])
def test_cards_beside_other_numbers_same_as_sql(spark, folder, name):
    assert same(spark, registry.QUERIES[name], registry.ORACLE[name], folder) > 1


def test_a_card_before_an_address_is_found(spark, folder):
    at = TEXTS.index(f"{CARD} 53.121.55.90")
    assert registry.QUERIES["card_findings"](spark, folder).where(f"doc_id = {at}").count() == 1
