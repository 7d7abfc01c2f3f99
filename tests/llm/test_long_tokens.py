"""Patterns stay linear in long unbroken texts, and say what the plain pattern says on short ones."""

import random
import re
import time

import pytest

from barloom.llm import secrets, toxicity

PLAIN = re.compile(r"\b(?:https?|s3|gs|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.amazonaws\.com\b", re.ASCII)


@pytest.mark.parametrize("seed", range(8))
def test_endpoints_are_those_of_one_pattern(seed):
    rng = random.Random(seed)
    bits = ["a", "-", ".", ".amazonaws.com", "amazonaws", "http://", "s3", "://", " ", "x9", "/", "é", "_", "COM", "com", '"']
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert list(secrets.endpoints(text)) == [m.span() for m in PLAIN.finditer(text)], text


LONG = ["a-" * 500_000, "a." * 500_000, "a." * 300_000 + "amazonaws.com", "-" * 1_000_000, "http" * 250_000, "password" * 120_000, "A1b" * 330_000]


@pytest.mark.parametrize("text", LONG, ids=lambda t: t[:8])
def test_secrets_of_a_megabyte_without_a_break(text):
    began = time.perf_counter()
    secrets.weak_parts(text, secrets.base_parts(text)) if hasattr(secrets, "weak_parts") else list(secrets.endpoints(text))
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize("token", ["x" * 1_000_000, "!" * 500_000 + "x", "@" * 500_000 + "x", "a" + "-" * 500_000], ids=["letters", "marks", "signs", "dashes"])
def test_noise_is_seen_in_linear_time(token):
    began = time.perf_counter()
    toxicity.NOISY.search(token)
    toxicity.ORNAMENT.sub("", token)
    toxicity.TRIPLE.search(token)
    assert time.perf_counter() - began < 3


def test_ornaments_are_cut():
    cut = lambda t: toxicity.ORNAMENT.sub("", t)
    assert [cut(t) for t in ("wow!!!", "wow!", "a$$$", "a$$", "a@@@b", "x|||", "x++++", "!!!")] == ["wow", "wow", "a", "a$$", "a@@@b", "x", "x", ""]
