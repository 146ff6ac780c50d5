"""Places that hold credentials, places that only look like it, and redaction."""

import pytest

from logloom.llm import credentials

YES = [
    "snmp-server community s3cretStr ro", "snmp-server host 10.1.1.1 version 2c Ta3K9JXPL", "snmp-server user p ops v3 auth sha iFs1QHo4wtk1PM priv aes iTodT0vPXeD5Ai", "set snmp community Tundr@!233 authorization read-only",
    '    community "3DTU97Vgzt" { authorization read-only; }', "enable secret 5 $1$TzSyNmt4$xJkzb5VmxBWxnQDBCbiD2m", "username a privilege 15 secret sha512 $6$99v91SQL$H5Cty", "password Breeze-ember-1133",
    " neighbor 10.1.1.1 password Will0w_626", "   neighbor PEERS-7 password tundra.canyon", "radius-server host 10.1.1.1 key 7 06BDDEA8C36D1887", " ip ospf message-digest-key 6 md5 Sh5HBMsWp6v2", "ntp authentication-key 5 md5 7 0875965B0F",
    " ip ospf authentication-key VVCtdfkA", '    authentication-key "$9$BW6P5.0bcc";', "  key-string falcon.willow", "   key 7c4a2382 7 00568AD44FCF31", " isis password clear falcon.orbit", " area-password md5 uiUi!#MvF",
    'set / x auth-password "Canyon-8229"', "tacacs secret-key $aes1$qm4iPy7w4S7=", 'set security ike policy P0 pre-shared-key hexadecimal "00cbc80f"', '     md5 4 key "$9$kSPykAU1";', '     10.1.1.1 secret "$9$1K06dFUV";',
    'NETBOX_TOKEN = "ba4b4c8b192ce65f"', "export TFTP_PW=49bd6a18901602", '  "pass": "b56dcd02-79d2-e838",', "apiToken = 'eyJuL.eyJWW.x'", "  passwd: Harbour-8937", 's.login("n", password="rPB2wAX" + "o0GzUc1")', "AUTH_HEADER: Basic c3ZjLWNmZzpn",
    "curl -H 'Authorization: Bearer 01f7a4a9-443a' https://x/", "copy x sftp://archiver:Co0JykHTwicv@10.1.1.1/", "get(b + '/p?api_key=ksXFq9877J')", "sshpass -p 'i4j0Xp5obKL' scp a b", "snmpwalk -v3 -u p -A PvV9fVTMxgxv -x AES -X QBzVCdUhNxSy 10.1.1.1",
    "! old enable pw was Pepper-8720", "# wifi passphrase walnut.granite", "! login for the vendor visit: guest / orbit.marble",
]
NO = [
    "service password-encryption", "   ntp trusted-key 7", "snmp-server community <REDACTED> ro", "   ip ospf authentication message-digest", "ip community-list LIST-27 permit 65392:500", "username o privilege 1 role r nopassword",
    "API_KEY = os.environ['INV_API_KEY']", "  password: {{ vault.lab_admin }}", "set / system keychain bgp key 1 algorithm hmac-sha-256", "  db_password: ''", "key chain KC3", "token = read_token('/run/creds/inv')", "copy x https://inv.net.example/cfg/",
    '  "client_secret": "<REDACTED>",', "export SRC_TOKEN=${VAULT_ECIRL}", "    password { minimum-length 12; format sha512; }", "    authentication-key-chain CHAIN-4;", "no password", "password = getpass.getpass('device password: ')", "set system login password minimum-length 18",
    "! the enable password lives in the vault, ask the duty engineer", "! secret ********** removed by export", "uuid e18b99a3-8d9c-a6c1-015d", "! image sha256 db7ee74b7070f9", "-----BEGIN CERTIFICATE-----", "ssh-ed25519 rK6rRN5gxaAHV2Soh ops@x", "    community SITE-20 members 65410:641;", "",
]
BLOCK = "a\n-----BEGIN RSA PRIVATE KEY-----\r\nAbC/+=\r\nxyz\r\n-----END RSA PRIVATE KEY-----\r\nb\n"
SCHEMA = "id bigint, owner string, text string"


def cases(spark, rows, **kw):
    found = credentials.line_cases(credentials.find(spark.createDataFrame(rows, SCHEMA), **kw))
    return sorted((r["id"], r["first_line"], r["last_line"]) for r in found.collect())


def test_places(spark):
    rows = [(i, f"h{i}", x) for i, x in enumerate(YES + NO)]
    assert [c[0] for c in cases(spark, rows)] == list(range(len(YES)))


def test_quoted_pass_phrases(spark):
    yes = ['passphrase: "correct horse battery staple"', "wifi_password = 'correct horse battery'", '  "passphrase": "correct horse", "user": "x"', 'set security ike policy P0 pre-shared-key ascii-text "correct horse battery"', 'enable secret 0 "correct horse"']
    no = ['password = input("the password please: ")', 'print("password: " + x + " is wrong")', 'password = "the user " + name', 'password: "Type your password: "', "log.warn('token: \"not set here\"')", 'read -p "password: " pw; echo "token: none today"']
    assert [c[0] for c in cases(spark, [(i, f"h{i}", x) for i, x in enumerate(yes + no)])] == list(range(len(yes)))


def test_blocks_and_folded_values(spark):
    open_end = "-----BEGIN PRIVATE KEY-----\nAbC\nDeF\n"
    folded = "x:\n  bind_password: >-\n    saffron.falcon\n    more\n  other: 1\n"
    escaped = 'k = "-----BEGIN EC PRIVATE KEY-----\\nU3rz\\n-----END EC PRIVATE KEY-----\\n"\nz\n'
    rows = [(1, "a", BLOCK), (2, "b", open_end), (3, "c", folded), (4, "d", escaped)]
    assert cases(spark, rows) == [(1, 2, 5), (2, 1, 3), (3, 3, 4), (4, 1, 1)]


def test_confirmed_literals_are_found_elsewhere(spark):
    rows = [(1, "a", "password Breeze-ember-1133\n"), (2, "b", "note\nask for Breeze-ember-1133 at the desk\n"), (3, "c", "xBreeze-ember-11339\n")]
    assert cases(spark, rows) == [(1, 1, 1), (2, 2, 2)]


def test_confirmed_literals_at_any_boundary_and_of_short_runs(spark):
    secrets = ["Abc12345", "Tundr@!407", "a-b-c-d-e-1", "!!ab12##", "Zz9é-Q8w7e"]
    places = [(i, f"h{i}", f"password {x}\n") for i, x in enumerate(secrets)]
    elsewhere = [(10 * k + i + 10, "o", f"note\nask: {a}{x}{b}\n") for i, x in enumerate(secrets) for k, (a, b) in enumerate((("", "."), ("`", "`"), ("*", "~"), ("_", "$ x")))]
    none = [(90 + i, "o", f"note\nask: x{x}1\n") for i, x in enumerate(secrets) if x[0].isalnum()]
    assert cases(spark, places + elsewhere + none) == [(i, 1, 1) for i, _, _ in places] + sorted((i, 2, 2) for i, _, _ in elsewhere)


def test_every_file_is_scanned_again(spark):
    """Embedded in other words, short, letters only, over several lines: a confirmed literal is found wherever it stands."""
    key = "-----BEGIN RSA PRIVATE KEY-----\nAbCdEf123456\nxyzXYZ789012\n-----END RSA PRIVATE KEY-----"
    folded = "x:\n  bind_password: >-\n    saffronFalcon\n    more9\n  other: 1\n"
    rows = [(1, "a", "password Zq7vT-9xLm2RkWp4\n"), (2, "b", "description legacy_Zq7vT-9xLm2RkWp4_x\n"), (3, "c", "copy tftp Zq7vT-9xLm2RkWp4.cfg\n"), (4, "d", "password a1,b2,c3,d4,e5\n"), (5, "e", "  # see 'a1,b2,c3,d4,e5'\n"), (6, "f", "token = 'FPwcwVZuktd'\n"), (7, "g", "was FPwcwVZuktd once\n"), (8, "h", folded), (9, "i", "old:\nsaffronFalcon\n    more9\n"), (10, "j", "password Ab3$xy\n"), (11, "k", "note Ab3$xy\n"), (12, "l", key)]
    assert cases(spark, rows) == [(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (5, 1, 1), (6, 1, 1), (7, 1, 1), (8, 3, 4), (9, 2, 3), (10, 1, 1), (11, 1, 1), (12, 1, 4)]


def test_texts_of_places(spark):
    """The texts that a line must hold leave none of the places out."""
    for pattern, words, any_case in credentials._patterns()[0]:
        for line in YES:
            assert not pattern.search(line) or any(w in (line.lower() if any_case else line) for w in words)


def test_literals_of_many_owners_are_placeholders(spark):
    rows = [(i, f"h{i}", "password sitewide-default\n") for i in range(20)] + [(99, "x", "password own-Secret-1\n")]
    assert cases(spark, rows) == [(99, 1, 1)]
    assert len(cases(spark, [(i, "one", r[2]) for i, r in enumerate(rows)])) == 21
    shared = [(i, f"h{i}", f"{x}\n") for i, x in enumerate(["snmp-server community Zq7vT9xLm2RkWp ro", "enable secret 5 $1$TzSyNmt4$xJkzb5VmxBWxnQDBCbiD2m"] * 20)]
    assert len(cases(spark, shared)) == 40


def test_redaction_leaves_the_rest(spark):
    text = 'a: 1\r\ntoken = "abcDEF123456"  # keep\r\n' + BLOCK
    files = spark.createDataFrame([(1, "a", text), (2, "b", "plain"), (3, None, None), (4, "c", "")], SCHEMA)
    out = {r["id"]: r["text"] for r in credentials.redact(files, credentials.find(files)).collect()}
    assert out[1].split("\n")[0:2] == ["a: 1\r", 'token = "<REDACTED>"  # keep\r'] and len(out[1].split("\n")) == len(text.split("\n"))
    assert "AbC" not in out[1] and out[1].endswith("\r\nb\n") and "xyz" not in out[1]
    assert (out[2], out[3], out[4]) == ("plain", None, "")


def test_empty_long_and_repeated(spark):
    assert cases(spark, []) == []
    long = "interface x\n" * 60_000 + "password Breeze-ember-1133\n"
    assert cases(spark, [(1, "a", long), (1, "a", long)]) == [(1, 60_001, 60_001)]
    df = spark.createDataFrame([(1, "a", "password Breeze-ember-1133", "x")], SCHEMA + ", literal string")
    assert credentials.find(df).count() == 1


@pytest.mark.parametrize("text", ["password", "password ", "token=", "secret: |\n", "-----BEGIN PRIVATE KEY-----"])
def test_stumps(spark, text):
    cases(spark, [(1, "a", text)])
