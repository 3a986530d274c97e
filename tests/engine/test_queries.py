import pytest

from shirabe import registry
from tests.oracle import DIR, same


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, name):
    assert same(spark, registry.QUERIES[name], registry.ORACLE[name]) > 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_scan_of_documents_finds_the_cards(spark):
    """The matcher and built-in functions find the same cards."""
    scanned = registry.QUERIES["scan_documents"](spark, DIR).where("rule_id = 'credit-card'").select("doc_id", "match").collect()
    cards = registry.QUERIES["card_findings"](spark, DIR).select("doc_id", "masked").collect()
    assert sorted(map(tuple, scanned)) == sorted(map(tuple, cards))


def test_fold_over_all_candidates_same_as_brute_force(spark):
    from shirabe.plans import relations

    lines, evictions = {}, []
    for r in relations._findings(spark, DIR).collect():
        lines.setdefault(r.k, []).append(r)
    rank = lambda x: (-x.confidence, x.fail_only, -x.score, x.start - x.end, x.rule_id)
    want = []
    for found in lines.values():
        kept = []
        for x in sorted(found, key=lambda x: (x.ordinal, x.start, x.end, x.rule_id, x.confidence, x.fail_only, x.score)):
            touched = [y for y in kept if y.start < x.end and x.start < y.end]
            if all(rank(x) < rank(y) for y in touched):
                kept = [y for y in kept if y not in touched] + [x]
                evictions.append(len(touched))
        want += [(x.k, x.ordinal, x.start, x.end, x.rule_id) for x in kept]
    assert sorted(map(tuple, registry.QUERIES["resolve_all_overlaps"](spark, DIR).collect())) == sorted(want)
    assert max(map(len, lines.values())) > 2 and min(map(len, lines.values())) == 1 and max(evictions) > 1
