import base64
import random
import re
import time

from ledgerlume.llm import secrets

B64 = base64.b64encode
PUBLIC_TYPE = b"\0\0\0\x0bssh-ed25519"


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def number(r, n):
    return der(2, bytes([1 + r.randrange(126)]) + r.randbytes(n - 1))


ZERO, ONE = der(2, b"\0"), der(2, b"\1")
RSA_ID, EC_ID, CURVE = der(6, bytes.fromhex("2a864886f70d010101")), der(6, bytes.fromhex("2a8648ce3d0201")), der(6, bytes.fromhex("2a8648ce3d030107"))
PBES = der(6, bytes.fromhex("2a864886f70d01050d"))


def string(x):
    return len(x).to_bytes(4, "big") + x


def samples(seed):
    """(name, bytes) of private keys and of what is like them."""
    r = random.Random(seed)
    n = lambda k: number(r, k)
    pkcs1 = der(0x30, ZERO, n(64), der(2, b"\1\0\1"), n(64), n(32), n(32), n(32), n(32), n(32))
    sec1 = der(0x30, ONE, der(4, r.randbytes(32)), der(0xA0, CURVE), der(0xA1, der(3, b"\0\4" + r.randbytes(64))))
    ed = der(0x30, ZERO, der(0x30, der(6, bytes.fromhex("2b6570"))), der(4, der(4, r.randbytes(32))))
    public = string(string(b"ssh-ed25519") + string(r.randbytes(32)))
    ssh = b"openssh-key-v1\0" + string(b"none") + string(b"none") + string(b"") + b"\0\0\0\1" + public + string(r.randbytes(136))
    good = {
        "pkcs1": pkcs1, "dsa": der(0x30, ZERO, n(64), n(20), n(64), n(64), n(20)), "sec1": sec1, "ed25519": ed, "pkcs8": der(0x30, ZERO, der(0x30, RSA_ID, der(5)), der(4, pkcs1)),
        "pkcs8 with attributes": der(0x30, ONE, der(0x30, EC_ID, CURVE), der(4, sec1), der(0xA0, der(0x30, RSA_ID))), "encrypted": der(0x30, der(0x30, PBES, der(0x30, der(4, r.randbytes(16)))), der(4, r.randbytes(96))), "ssh": ssh,
    }
    spki = der(0x30, der(0x30, RSA_ID, der(5)), der(3, b"\0" + der(0x30, n(64), der(2, b"\1\0\1"))))
    bad = {
        "spki": spki, "ec public": der(0x30, der(0x30, EC_ID, CURVE), der(3, b"\0\4" + r.randbytes(64))), "pkcs1 public": der(0x30, n(128), der(2, b"\1\0\1")), "signature": der(0x30, n(32), n(32)),
        "certificate": der(0x30, der(0x30, der(0xA0, der(2, b"\2")), n(8), der(0x30, RSA_ID, der(5)), der(0x30), spki), der(0x30, RSA_ID, der(5)), der(3, b"\0" + r.randbytes(64))),
        "request": der(0x30, der(0x30, ZERO, der(0x30), spki, der(0xA0)), der(0x30, RSA_ID), der(3, b"\0" + r.randbytes(64))), "octets": der(0x30, ZERO, der(4, r.randbytes(40))),
        "cut": pkcs1[:-1], "longer": pkcs1 + b"\0", "inner length": der(0x30, ZERO, n(40), n(30)[:-2], n(20)), "no key inside": der(0x30, ZERO, der(0x30, RSA_ID, der(5)), der(4, b"\x30\x7f" + r.randbytes(40))), "ssh tail": ssh + b"x", "ssh without keys": ssh[:35] + b"\0\0\0\0" + ssh[39:],
    }
    return good, bad


def shape(data):
    """DER as nested text, or None: read by another way than the operator's."""
    out = ""
    while data:
        if len(data) < 2:
            return None
        tag, n, data = data[0], data[1], data[2:]
        if n >= 128:
            k = n - 128
            if not 1 <= k <= 4 or len(data) < k or data[0] == 0:
                return None
            n, data = int.from_bytes(data[:k], "big"), data[k:]
            if n < 128:
                return None
        if n > len(data) or (tag in (2, 6) and n == 0):
            return None
        body, data = data[:n], data[n:]
        out += f"<{tag:02x}"
        if tag & 32:
            inner = shape(body)
            if inner is None:
                return None
            out += inner
        elif tag == 4:
            out += ":" + ("d" if body and shape(body) else "") + "." * min(n, 40)
        elif tag == 2 and n == 1:
            out += f"={body[0]}"
        out += ">"
    return out


ANY = r"(?:<[^<>]*(?:<[^<>]*(?:<[^<>]*(?:<[^<>]*(?:<[^<>]*>)*[^<>]*>)*[^<>]*>)*[^<>]*>)*[^<>]*>)"
PRIVATE = re.compile(rf"<30(<02=[01]>(<02(=\d+)?>){{3,}}|<02=[01]><30<06>{ANY}*><04:d\.+>(<(a0|81|a1){ANY}*>)*|<02=1><04:d?\.{{16,}}>(<a0{ANY}*>)?(<a1{ANY}*>)?|<30<06>{ANY}*><04:d?\.{{8,}}>)>")


def private(data):
    return len(data) >= 24 and bool(PRIVATE.fullmatch(shape(data) or ""))


def test_shapes_of_keys_and_of_what_is_like_them():
    for seed in range(20):
        good, bad = samples(seed)
        for name, data in good.items():
            assert (secrets.is_openssh_key if name == "ssh" else secrets.is_der_key)(data), name
            assert name == "ssh" or private(data), name
        for name, data in bad.items():
            assert not secrets.is_der_key(data) and not secrets.is_openssh_key(data), name
            assert not private(data), name


def test_spans_of_keys_in_texts():
    good, bad = samples(3)
    for name, data in good.items():
        kind = "openssh" if name == "ssh" else "der"
        for code in (B64(data).decode(), B64(data).decode().rstrip("="), base64.urlsafe_b64encode(data).decode()):
            for head in ("", "x = ", "data:/", "_", "\\n", "é "):
                text = f"{head}{code} end"
                start = len(head)
                assert [x for x in secrets.find_secrets(text) if x[1] == kind] == [(start, kind, start + len(code))], (name, head)
        if kind == "der":
            for code in (data.hex(), data.hex().upper()):
                assert (2, "der", 2 + len(code)) in secrets.find_secrets("k " + code)
        lines = lambda end: end.join(B64(data).decode()[i : i + 64] for i in range(0, 10**4, 64)).rstrip(end)  # noqa: E731, B023
        for end in ("\n", "\r\n", "\\n"):
            text = f"a -----BEGIN RSA PRIVATE KEY-----{end}{lines(end)}{end}-----END RSA PRIVATE KEY----- b"
            assert (2, "pem", len(text) - 2) in secrets.find_secrets(text)
    sealed = B64(bytes(range(96))).decode()
    text = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011\n\n{sealed}\n-----END RSA PRIVATE KEY-----"
    assert [x[1] for x in secrets.find_secrets(text)] == ["pem"]
    assert secrets.find_secrets(text.replace("Proc-Type: 4,ENCRYPTED\n", "")) == []
    for name, data in bad.items():
        for code in (B64(data).decode(), "-----BEGIN PRIVATE KEY-----\n" + B64(data).decode() + "\n-----END PRIVATE KEY-----", "-----BEGIN PUBLIC KEY-----\n" + B64(data).decode() + "\n-----END PUBLIC KEY-----"):
            assert [x for x in secrets.find_secrets(code) if x[1] not in secrets.BASE] == [], name


def brute(text):
    """Every end of every run of base64 and every run of hexadecimal, tried as a key."""
    out = set()
    for m in re.finditer(r"[A-Za-z0-9+/_-]{40,}={0,2}", text):
        for at in range(len(m[0])):
            body = m[0][at:].rstrip("=").translate(str.maketrans("-_", "+/"))
            if len(body) % 4 != 1 and private(base64.b64decode(body + "=" * (-len(body) % 4))):
                out.add((m.start() + at, "der", m.end()))
                break
    for m in re.finditer(r"[0-9A-Fa-f]{48,}", text):
        if len(m[0]) % 2 == 0 and private(bytes.fromhex(m[0])):
            out.add((m.start(), "der", m.end()))
    return out


def test_added_key_spans_against_brute_force():
    r = random.Random(12)
    found = 0
    for seed in range(25):
        good, bad = samples(seed)
        codes = [B64(x).decode() for x in (*good.values(), *bad.values())] + [x.hex() for x in good.values()] + [x.hex().upper() for x in bad.values()]
        codes += [B64(r.randbytes(60)).decode() for _ in range(4)] + ["M" * 50, "MI" * 40, "MEMEME" * 20]
        r.shuffle(codes)
        text = "".join(c + r.choice([" ", "\n", "/", "=", "M", "", ", "]) for c in codes)
        got = {x for x in secrets.find_secrets(text) if x[1] == "der"}
        assert got == brute(text)
        found += len(got)
    assert found > 100


def test_time_is_in_proportion_to_the_text():
    for text in ("MI" * 400_000, "-----BEGIN PRIVATE KEY-----" + "\n" * 400_000, "-----BEGIN PRIVATE KEY-----\n" + "A:  " * 200_000, "-----BEGIN PRIVATE KEY-----" * 30_000, "b3Blbn" * 100_000):
        start = time.monotonic()
        secrets.find_secrets(text)
        assert time.monotonic() - start < 5
