"""Operators on long and varied texts: time in proportion to length, memory within bounds."""

import random
import resource
import time

import numpy as np

from catalog_engine.llm import language, secret_scan


def seconds(text):
    start = time.process_time()
    spans = secret_scan.find(text)
    return time.process_time() - start, spans


def test_secret_chains_are_read_once():
    """A secret put together in steps, each of which refers to all before."""

    def chain(n):
        return 'password = "Zx9qK2"\n' + "".join(f'password = password + "aB3x{i}"\n' for i in range(n))

    took, spans = seconds(chain(4_500))
    assert len(chain(4_500)) > 147_000 and took < 1.5 and len(spans) == 4_501
    longer, more = seconds(chain(18_000))
    assert len(more) == 18_001 and longer < 10 * max(took, 0.2)
    # Through names of their own, found where they stand when the last one is sensitive.
    text = 'k0 = "q0"\n' + "".join(f'k{i} = k{i - 1} + "q{i}"\n' for i in range(1, 3_000)) + "token = k2999\n"
    took, spans = seconds(text)
    assert took < 1.5 and len(spans) == 3_000 and text[spans[0].start : spans[0].end] == "q0"


def test_secrets_among_many_base_spans():
    text = "".join(f'secret_key = "Zx9q{i}K2mV7pL4"\n{i:032x}\n' for i in range(9_000))
    took, spans = seconds(text)
    assert took < 4 and len(spans) == 18_000
    # A literal that a base span covers is no span of its own, whichever base span it is.
    covered = f'token = "{"ab12" * 8}"\npassword: hunter2hunter2\n'
    assert {s.kind for s in secret_scan.find(covered)} == {"assign", "hex"}


def test_scores_of_long_values():
    for text in ("x" * 80, "*" * 90, "example " + "aB3" * 40, "your_" + "aB3" * 40, "a://" + "bC4" * 30):
        assert secret_scan.literal_score(text) == 0
    assert secret_scan.literal_score("aB3$" * 30) > 0.6
    # The parts of a value count together, and a mark between two parts is seen.
    parts = [secret_scan.Atom(0, 2, "ht"), secret_scan.Atom(3, 6, "tp:"), secret_scan.Atom(7, 20, "//aB3kLm9Qr7x")]
    assert secret_scan.Value(parts).looks_secret() == 0


def test_language_of_varied_scripts_in_bounded_memory():
    draw = random.Random(1)
    texts = ["".join(map(chr, draw.choices(range(0x4E00, 0x9FFF), k=4_000))) for _ in range(128)]
    store = language.Vectors()
    store.bundles(texts[:2])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    made = store.bundles(texts)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 400
    assert np.allclose(np.linalg.norm(made, axis=1), 1)


def test_bundles_do_not_depend_on_parts(monkeypatch):
    draw = random.Random(2)
    texts = ["".join(draw.choices("abcdeäöü .1", k=n)) for n in (0, 1, 5, 400, 3_000)] + [None, "12 34"]
    whole = language.Vectors().bundles(texts)
    for part, slice_, stored in ((50, 7, 30), (1_000, 64, 64)):
        monkeypatch.setattr(language, "PART", part)
        monkeypatch.setattr(language, "SLICE", slice_)
        monkeypatch.setattr(language, "_STORED", stored)
        assert np.allclose(language.Vectors().bundles(texts), whole, atol=1e-6)
    # By hand: the product of the letters' vectors, rotated by place.
    store = language.Vectors()
    keys = next(iter(store.grams("ab")))
    assert [(k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF) for k in keys.tolist()] == [(0, 97, 98), (97, 98, 0)]
    want = np.roll(store.letter(0), 2) * np.roll(store.letter(97), 1) * store.letter(98)
    assert (store.rows(keys)[0] == want).all()
