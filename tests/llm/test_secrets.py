"""Novel secrets: recall for random strings of many alphabets, precision on code and prose."""

import argparse
import email.message
import http.client
import inspect
import random
import ssl
import string
import subprocess
import urllib.request

import pytest

from larkspur.llm import secret_scan as S

ALPHABETS = {
    "base62": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
    "upper36": string.ascii_uppercase + string.digits,
    "base36": string.ascii_lowercase + string.digits,
    "base32": string.ascii_uppercase + "234567",
    "lower": string.ascii_lowercase,
    "letters": string.ascii_letters,
    "digits": string.digits,
}


@pytest.mark.parametrize("name", ALPHABETS)
def test_random_strings_are_found(name):
    r = random.Random(11)
    for n in (20, 32, 40):
        made = ["".join(r.choices(ALPHABETS[name], k=n)) for _ in range(300)]
        found = sum(S.scan(f"Authorization: Bearer {m} in use")[1] != [] for m in made)  # 32 digits are hex already
        assert found >= 0.95 * len(made), (name, n, found)


@pytest.mark.parametrize("word", ("key", "auth", "pwd"))
def test_plain_contexts(word):
    assert [k for *_, k in S.scan(f"the {word} k7q2mzx0v9w4h8bt1pj6 is set")[1]] == [3]


def test_long_words_are_no_secrets():
    for word in ("internationalization", "misunderstandings-everywhere", "getUserNameFromSession", "responsibilities2", "DEPARTMENT_OF_TRANSPORTATION", "version3internationalization18"):
        assert S.scan(f"the private key is {word} here")[1] == []


def test_most_strings_of_code_are_no_secrets():
    found = seen = 0
    for module in (argparse, email.message, http.client, inspect, ssl, subprocess, urllib.request):
        text = inspect.getsource(module)
        found += sum(k == 3 for *_, k in S.scan(text)[1])
        for word in S.SENSITIVE_AT.finditer(text.lower()):
            seen += len(S.CANDIDATE.findall(text[word.end() : word.end() + S.REACH]))
    assert seen > 100 and found <= 0.03 * seen


def test_compression_alone_decides():
    novel = S.novelty().novel
    for text in ("0123456789abcdef", "aaaaaaaaaaaaaaaaaaaaaaaa", "----------------------", "password_password_password"):
        assert not novel("key = ", text, "")
    secret = "q7zk2vxw9jh4pt8m"
    assert novel("key = ", secret, "") and not novel(f"old = {secret}; key = ", secret, "")
