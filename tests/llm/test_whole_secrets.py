"""Every run of a word, and secrets of other forms than quoted hexadecimal ones."""

from __future__ import annotations

from tripstrata.llm.secret_forest import all_findings, scan

HEX = "04dbe1f2a3b4c5d6e7f8091a2b3c4d5e6f708192"
MIXED = "aB3dE5fG7hJ9kL1mN3pQ5rS7tU9vW1xY"
AWS = "AKIA" + "ABCDEFGH12345678"
GITHUB = "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"
JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTYifQ.abcDEF123_-x"
FILLER = [(100 + i, f"see averyveryverylongword/of/prose{i:04d} next") for i in range(60)]


def test_every_run_is_a_finding(documents):
    rows = [(1, f'{{"request_id":"aaaaaaaaaaaaaaaa","token":"{HEX}"}}'), (2, f"first_identifier_x:{MIXED},{HEX}")]
    got = sorted((r["doc_id"], r["word_no"], r["run_no"], r["candidate"]) for r in all_findings(documents(rows)).collect())
    assert got == [
        (1, 0, 0, "aaaaaaaaaaaaaaaa"),
        (1, 0, 1, HEX),
        (2, 0, 0, "first_identifier_x"),
        (2, 0, 1, MIXED),
        (2, 0, 2, HEX),
    ]


def test_forms_of_secrets(documents):
    secret = {
        1: f'{{"request_id":"aaaaaaaaaaaaaaaa","token":"{HEX}"}}',
        2: f"token={HEX}",
        3: f"export aws {AWS} here",
        4: f"remote {GITHUB}",
        5: f"Authorization Bearer {JWT}",
        6: f'api_key: "{MIXED}"',
        7: f"auth={MIXED}",
        8: f'token = "{HEX}"',
        9: f"some_long_access_key:{MIXED}",
    }
    rows = scan(documents([*secret.items(), *FILLER]), whole=True).collect()
    assert {r["doc_id"] for r in rows if r["is_secret"]} == set(secret)
    assert {(r["doc_id"], r["candidate"]) for r in rows if r["is_secret"]} >= {(1, HEX), (2, HEX), (7, MIXED), (9, MIXED)}
    assert not [r for r in rows if r["candidate"] == "aaaaaaaaaaaaaaaa" and r["is_secret"]]
