"""Personal data written in ways that the trees' examples don't have, and numbers that only their surroundings tell apart."""

import random

import pytest

from quern.llm import personal_data


@pytest.fixture(scope="module")
def model(spark):
    return personal_data.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def added(text, model):
    return {(personal_data.KINDS[k], text[s:e]) for s, k, e in personal_data.added_spans(text, personal_data.base_spans(text), model)}


def test_held_out_formats(spark, model):
    """Precision and recall over formats that no example is written in."""
    rng = random.Random(8)
    num = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    hexa = lambda: f"{rng.randrange(4096, 65536):x}"
    name = lambda: rng.choice(["ana", "joe.doe", "m_kim", "lee77"])
    make = [
        ("email", lambda: f"{name()}(at)firm{num(1)}.co.uk"), ("email", lambda: f"{name()} {{at}} firm {{dot}} org"), ("email", lambda: f"{name()}[at]mail.example.net"),
        ("phone", lambda: f"{rng.randrange(2, 10)}{num(2)} {num(3)}-{num(4)}"), ("phone", lambda: f"({num(3)}) {num(3)} {num(4)}"),
        ("ip", lambda: f"fd00::{hexa()}:{hexa()}"), ("ip", lambda: ":".join(["2a00", *[hexa() for _ in range(7)]])),
    ]
    none = [
        lambda: f"total is {num(3)} {num(3)} {num(4)} units", lambda: f"order {num(10)}", lambda: f"page {num(3)} of {num(3)}", lambda: f"at {rng.randrange(10, 24)}:{num(2)}:{num(2)}",
        lambda: f"pages {num(2)}-{num(3)}", lambda: f"version {num(1)}.{num(2)}.{num(4)}", lambda: f"we met at noon. Then {num(2)} came",
    ]
    words = [w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect() for w in (r["text"] or "").split()[:60]]
    right = wanted = wrong = 0
    for i in range(700):
        about = lambda: " ".join(rng.choice(words) for _ in range(8))
        kind, span = (make[i % len(make)][0], make[i % len(make)][1]()) if i % 2 else (None, none[i // 2 % len(none)]())
        found = added(f"{about()} {span} {about()}", model)
        wanted += kind is not None
        right += (kind, span) in found
        wrong += len(found - {(kind, span)})
    assert right >= 0.75 * wanted and right >= 0.9 * (right + wrong), (right, wanted, wrong)


@pytest.mark.parametrize(
    "text, span",
    [
        ("phone 0175557713", ("phone", "0175557713")), ("tel 5551234567", ("phone", "5551234567")), ("server fe80::1 is down", ("ip", "fe80::1")), ("the total is 123 456 7890 units", None), ("order 5551234567", None),
        ("id 20240101123", None), ("page 123 of 456", None), ("12:30:45", None),
    ],
)
def test_what_surroundings_tell(model, text, span):
    assert added(text, model) == ({span} if span else set())
