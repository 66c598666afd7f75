"""Credentials in concatenated strings: found once, every part redacted."""

import pytest

from siftgrain.llm import secrets

A, B, C = "xoxb-3016", "3617409-4sX4QDXJd6og", "XN22x9MkDUZl"
HEADER = "Authorization: Bearer 9fXkQ2mZ7LpT4"


@pytest.mark.parametrize(
    "text, parts, line",
    [
        (f'TOKEN = "{A}" + "{B}";', [A, B], 1),
        (f'x = 1\nTOKEN = "{A}" + "{B}" + \'{C}\'', [A, B, C], 2),
        (f'x = 1\ntoken = "{A}" +  // first\n    "{B}" +\n    "{C}";', [A, B, C], 2),
        (f'token = "{A}"\n    + "{B}"\n    + "{C}";', [A, B, C], 1),
        (f'token = (\n    "{A}"\n    f"{B}"\n)', [A, B], 2),
        (f'$token = "{A}" . "{B}"', [A, B], 1),
        (f'token = "{A}" \\\n  "{B}"', [A, B], 1),
        ('api_key = "sk" + "_live_" + "1R40nJ9SPQaiMefNL1"', ["sk", "_live_", "1R40nJ9SPQaiMefNL1"], 1),
        (f'h = "{HEADER}" + "vRb8nWc"', ["9fXkQ2mZ7LpT4", "vRb8nWc"], 1),
        ('url = "postgres://timer:21ABC" + "BCsLVK@db.example:1633/q"', ["21ABC", "BCsLVK"], 1),
    ],
)
def test_every_part_is_redacted(text, parts, line):
    found = secrets.find_credentials(text)
    assert [f[0] for f in found] == [line] and [text[a:b] for a, b in found[0][1]] == parts
    clean, n = secrets.redact(text)
    assert n == 1 and clean.count("[REDACTED]") == len(parts) and not any(p in clean for p in parts)
    assert clean.count("\n") == text.count("\n") and clean.count('"') == text.count('"')


def test_strings_beside_each_other_stay_apart():
    text = 'items:\n  - "RemoteBatch"\n  - "of"\n'
    assert secrets.redact(text) == (text, 0)
    assert secrets.redact('f(password="RemoteBatch6033#", "plain")')[0] == 'f(password="[REDACTED]", "plain")'


BASE36, MIXED = "3ax6xnjp29jd6fds4gc373sgvjxteol0", "9fXkQ2mZ7LpT4vRb8nWc"


@pytest.mark.parametrize(
    "text, value",
    [
        (f'api_key = "{BASE36}"', BASE36), (f'API_KEY = "{BASE36.upper()}"', BASE36.upper()), ('totp_secret: "JBSWY3DPEHPK3PXPGI4TQN5B"', "JBSWY3DPEHPK3PXPGI4TQN5B"),
        ('password = "hunter2hunter2"', "hunter2hunter2"), ('db_password: "winter#2024"', "winter#2024"),
        (f"API_KEY={MIXED}", MIXED), (f"export API_KEY={MIXED}", MIXED), (f"api_key: {MIXED}", MIXED), (f"api.token = {BASE36}", BASE36), (f"# key {MIXED} of the old host", MIXED), ("DB_PASSWORD=hunter2hunter2", "hunter2hunter2"),
        ('x = "aB3$cD5!eF7&gH9%jK2?mN4#pQ6*rS8^tU1~"', "aB3$cD5!eF7&gH9%jK2?mN4#pQ6*rS8^tU1~"), ('secret = "' + MIXED * 300 + '"', MIXED * 300),
    ],
)
def test_every_alphabet_and_length(text, value):
    found = secrets.find_credentials(text)
    assert [text[a:b] for _, spans in found for a, b in spans] == [value]


@pytest.mark.parametrize(
    "text",
    [
        'cache_key = "user-profile-v2"', "token = readToken2(x)", "private static final String AUTH_TOKEN_8M6M = null;", 'token_env = "AUTH_TOKEN_8M6M"', "API_KEY=$API_KEY_5B1W", 'content_hash = "3ax6xnjp29jd6fds4gc373sgvjxteol0"',
        'auth_kind = "oauth2"', 'password_hash = "$2b$12$R9h/cIPz0gi.URNNX3kh2OPST9"', "key = sha256Digest", 'signing_algorithm_key = "ecdsa-p256-sha256"',
    ],
)
def test_names_and_digests_stay(text):
    assert not secrets.find_credentials(text)
