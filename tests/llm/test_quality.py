from catalog_engine.llm import quality


def brute(text):
    words = (text or "").split()
    seen, hit = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit.update(j for i in places for j in range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if x.split()]
    return len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(hit)


def test_measurements_equal_brute_force(docs):
    loop = "a b c d e f g " * 9
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, loop), (5, "x " * 5), (6, "x " * 6), (7, "x " * 7),
        (8, "one\ntwo\none\n\n \none"), (9, loop + "new words here " + loop), (10, "a b c d e z a b c d e"),
        (11, "é" * 30 + " \U0001f600 ###"), (12, " ".join(f"w{i}" for i in range(3000)) + " " + loop),
    ]
    got = quality.build_ledger(docs(rows)).collect()
    assert len(got) == len(rows)
    for row in got:
        assert (row.n_words, row.word_chars, row.n_dup_lines, row.n_repeat_words) == brute(
            dict(rows)[row.doc_id]
        ), row.doc_id


def test_policies_and_ablation_use_the_bits_only(docs):
    clean = "Some plain words that follow each other in a line of text without any repeat at all."
    rows = [(1, clean), (2, "short"), (3, clean.upper()), (4, "x y " * 40), (5, None)]
    ledger = quality.build_ledger(docs(rows))
    kept = {r.doc_id: r.kept for r in quality.apply_policy(ledger, quality.STRICT).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}
    base = {r.doc_id: r.kept for r in quality.apply_policy(ledger, quality.BASE).collect()}
    assert base[3] and not base[4]
    bits = {r.doc_id: r.failed_bits for r in ledger.collect()}
    names = list(quality.RULES)
    for row in quality.ablate(ledger, quality.STRICT).collect():
        bit = 1 << names.index(row.rule)
        assert row.n_failed == sum(bool(b & bit) for b in bits.values())
        assert row.n_only == sum(b == bit for b in bits.values())
        assert row.n_docs == 5


def test_awkward_rows_and_empty_table(docs, awkward):
    assert quality.build_ledger(awkward).count() == 8
    empty = quality.build_ledger(docs([]))
    assert empty.count() == 0
    assert [r.n_docs for r in quality.ablate(empty, quality.BASE).collect()] == [0, 0]


def test_no_python_in_the_plan(docs):
    plan = quality.build_ledger(docs([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
