"""Secret scans: regular-expression candidates, and a random forest that removes false positives.

Candidates are long runs of key characters in whole texts. The forest judges each by its length, its
transitions between character kinds, how much of it known words cover, whether it stands in a path or address, and the words
around it. It is trained on labelled findings: a table of (text, start, length, is_secret), of which
``sample_findings`` makes a default one from rules (keys of common kinds after naming words; hashes, ids, paths, placeholders and long words that are none).
Known words come from a dictionary: the whole words of a public tokenizer's vocabulary, whose path is a parameter, or a short list of words of program texts.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Key characters in a row that make a candidate; shorter ones only after a naming word and a sign of assignment.
LONG, SHORT = 16, 8
_LONG = re.compile(rf"[A-Za-z0-9+/_\-]{{{LONG},}}(?:={{1,2}}(?![A-Za-z0-9+/_=\-]))?")  # '=' as trailing padding only: before more characters it ends a name
_NAME = r"(?:password|passwd|pwd|secret|token|(?:api|secret|access|private|signing)[_-]?key|auth)[\"']?\s{0,3}[:=]"
_NAMED = re.compile(rf"(?i){_NAME}\s{{0,3}}[\"']?(?!{_NAME})((?:(?!&[a-z_][\w.\-]*=)[^\s\"'<>,;]){{{SHORT},}})")  # up to the next parameter of an address
#: Words that name a secret, and words that name something else of that look (fixed values).
NAMING = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "key", "auth", "bearer", "credential", "private")
OTHER = ("commit", "sha", "sha256", "md5", "checksum", "digest", "hash", "etag", "uuid", "guid", "id", "version", "revision", "build", "isbn", "card", "phone", "integrity", "list", "playlist", "video", "cid", "ipfs", "fingerprint", "thumbprint", "asset", "mappings", "serial", "blob", "image", "src", "certificate", "crt", "cert", "publickey", "public_key", "pubkey")
#: Ends of names that tell of something else; first characters of public encodings; and schemes of public keys (fixed values).
OTHER_ENDS = ("hash", "digest", "checksum", "etag", "integrity", "fingerprint", "_id", "-id", "_sha", "version", "publickey", "public_key", "certificate", "playlist")
PUBLIC = ("Qm", "bafy", "bafk", "PL", "UU", "sha1-", "sha256-", "sha384-", "sha512-", "AAAA", "iVBOR", "R0lGOD", "PHN2Zy", "/9j/", "W/", "AAAB")
SCHEMES = re.compile(r"(?:ssh-(?:rsa|dss|ed25519)|ecdsa-sha2-nistp\d+|ssh-ed25519-cert\S*)\s+$")
_URI, _HEADER = re.compile(r"(?i)data:[\w.+-]*/?[\w.+-]*(?:;[\w=.-]+)*;base64,\s*$"), re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,40})-----")
#: How far before a candidate the head of its block is looked for.
BLOCK = 16_384
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "eyJ", "npm_", "hf_")
#: Words of program texts, of which the default findings are made, and the dictionary where none is given (fixed values).
WORDS = frozenset("account action address admin all and api app archive asset auth backup base build button cache center class client code color com commit common config container content control count data date default delete demo dev directory document download en error event example false field file files filter first font form from function group header height help home id img index info input internal item key language layout left length line link list local log login main manager master media menu message method mobile model module name network next node none number object online open option order output package page panel password path pipeline placeholder point position post prod product profile project property public query read record release request resource response result right role root row sample script search section secret select server service session set setting size source spark src start state static status storage store string style sub system tab table target template test text the theme this time title token tool top train true type update url user users value version video web window with world your".split())

FEATURES = ("length", "kinds", "switches", "case switches", "digits", "uppers", "hex", "entropy", "most common", "runs", "pairs", "known words", "prefix", "signs", "in path", "assigned", "quoted", "naming word", "other word", "near naming", "public start", "public scheme", "data address", "block", "whole line")


def dictionary(path: str) -> frozenset[str]:
    """The whole words of at least four letters in the BPE vocabulary at ``path`` (a file of the tokenizers library whose tokens mark word ends), and WORDS."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model["end_of_word_suffix"]
    return WORDS | {w for t in model["vocab"] if t.endswith(end) and len(w := t.removesuffix(end)) >= 4 and w.isalpha() and w.isascii()}


def candidates(text: str) -> list[tuple[int, int]]:
    """``(start, length)`` in code points of all candidates of a whole text, in order, without overlaps."""
    found = {m.start(): m.end() for m in _LONG.finditer(text)}
    if ":" in text or "=" in text:
        for m in _NAMED.finditer(text):
            s, e = m.start(1), m.end(1)
            found[s] = max(found.get(s, e), e)
    out: list[tuple[int, int]] = []
    for s, e in sorted(found.items()):
        if out and s < out[-1][0] + out[-1][1]:
            if e > out[-1][0] + out[-1][1]:
                out[-1] = (out[-1][0], e - out[-1][0])
            continue
        out.append((s, e - s))
    return out


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _covered(s: str, known: Collection[str]) -> float:
    """The share of characters in letter runs that are known words, or that look like words (vowels among few consonants, one case)."""
    good = 0
    for m in re.finditer(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", s):
        w = m[0].lower()
        vowels = sum(c in "aeiouy" for c in w)
        if w in known or len(w) >= 5 and 0.2 <= vowels / len(w) <= 0.7 and not re.search(r"[^aeiouy]{6}", w):
            good += len(w)
    return good / len(s)


def _block(text: str, start: int) -> float:
    """1 inside a private key's block, -1 inside another one (a certificate, a public key), 0 outside of any."""
    last = None
    if text.rfind("-----BEGIN ", max(0, start - BLOCK), start) >= 0:
        for last in _HEADER.finditer(text, max(0, start - BLOCK), start):
            pass
    return 0.0 if last is None or last[1] == "END" else 1.0 if "PRIVATE" in last[2] else -1.0


def _shape(s: str, chunk: int = 1 << 20) -> tuple[list[int], int, int, int, int, list[int]]:
    """``(characters of each kind, changes of kind, changes of case, longest run, different pairs, counts of characters)``, in chunks so that a long candidate takes little memory."""
    alphabet = np.array(sorted(map(ord, set(s))), np.uint32)
    kind_of = np.array([_kind(chr(c)) for c in alphabet], np.int8)
    count, kinds, switches, cases, longest, edge, pairs = np.zeros(len(alphabet), np.int64), [0] * 4, 0, 0, 1, 0, np.empty(0, np.int64)
    for at in range(0, len(s), chunk):
        code = np.searchsorted(alphabet, np.frombuffer(s[at : at + chunk + 1].encode("utf-32-le", "surrogatepass"), "<u4"))  # one more, to see the pair across the border
        count += np.bincount(code[:chunk], minlength=len(alphabet))
        kind = kind_of[code]
        changed = kind[1:] != kind[:-1]
        switches += int(changed.sum())
        cases += int((changed & (kind[1:] < 2) & (kind[:-1] < 2)).sum())
        pairs = np.union1d(pairs, code[:-1] * len(alphabet) + code[1:])
        edges = np.flatnonzero(code[1:] != code[:-1]) + at + 1
        if len(edges):
            longest, edge = max(longest, int(np.diff(edges, prepend=edge).max())), int(edges[-1])
    for k in range(4):
        kinds[k] = int(count[kind_of == k].sum())
    return kinds, switches, cases, max(longest, len(s) - edge), len(pairs), count.tolist()


def describe(text: str, start: int, length: int, known: Collection[str] = WORDS) -> list[float]:
    """The features of a candidate, as named in FEATURES."""
    s = text[start : start + length]
    kinds, switches, cases, longest, pairs, count = _shape(s)
    n = len(s)
    before, after = text[max(0, start - 60) : start], text[start + length : start + length + 30]
    words = re.findall(r"[A-Za-z][A-Za-z_\-]*\d*", before.lower())[-5:]
    last = words[-2:]
    return [
        min(n, 120), sum(k > 0 for k in kinds), switches / max(n - 1, 1), cases / max(n - 1, 1),
        kinds[2] / n, kinds[1] / n, sum(s.count(c) for c in "0123456789abcdefABCDEF") / n, -sum(x / n * math.log2(x / n) for x in count), max(count) / n,
        longest, pairs / max(n - 1, 1), _covered(s, known), float(s.startswith(PREFIXES)),
        sum(s.count(c) for c in "-_/") / n, float(bool(re.search(r"[/\\.@]$|://\S*$", before)) or after[:1] in ("/", "@") or s.count("/") > 1 or "." in after[:1] and after[1:2].isalpha()),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))), float(before[-1:] in "\"'" and before[-1:] != "" and after[:1] == before[-1:]),
        float(any(w in NAMING or w.endswith(("token", "secret", "password", "_key")) for w in last)), float(any(w in OTHER or w.endswith(OTHER_ENDS) for w in last)), float(any(w in NAMING for w in words)),
        float(s.startswith(PUBLIC)), float(bool(SCHEMES.search(before)) or bool(re.match(r"sha(?:1|224|256|384|512)-", s))), float(bool(_URI.search(before))), _block(text, start),
        float((not before or before[-1] == "\n") and (not after or after[0] in "\r\n")),
    ]


def sample_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """``n`` labelled findings ``(text, start, length, is_secret)`` made from rules, and half as many of public encodings and secrets of the same look; the same at every call."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    b64, hexa = low + up + num + "+/", num + "abcdef"
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ción que mente schaft keit ung eau elle tion".split()
    words = sorted(WORDS)
    out = []
    for i in range(n):
        prose = lambda k: " ".join("".join(pick(syllables) for _ in range(int(rng.integers(1, 5)))) for _ in range(k))
        name = pick(("token", "secret", "password", "api_key", "apiKey", "auth_token", "client_secret", "SECRET_KEY", "access_key", "TOKEN"))
        sign, quote = pick((" = ", "=", ": ", ":", " := ")), pick(('"', '"', "'", ""))
        good = i % 2 == 0
        if good:
            body = pick((
                lambda: chars(hexa, pick((32, 40, 64))), lambda: chars(b64, int(rng.integers(20, 64))), lambda: chars(low + up + num, int(rng.integers(16, 48))), lambda: chars(hexa, pick((32, 40, 64))).upper(),
                lambda: pick(("AKIA", "ASIA")) + chars(up + pick((num, num, num, "")), 16), lambda: pick(("ghp_", "gho_", "glpat-", "npm_", "hf_")) + chars(low + up + num, 36), lambda: pick(("sk_live_", "rk_live_")) + chars(low + up + num, 24), lambda: "eyJ" + chars(b64, 60),
                lambda: chars(low + up + num + "!%&", int(rng.integers(10, 18))),
            ))()
            bare = body.startswith(PREFIXES) and rng.random() < 0.5
            left = prose(4) + " " + ("" if bare else name + sign + quote)
            right = ("" if bare else quote) + " " + prose(3)
            if not bare and rng.random() < 0.2:  # a parameter of an address
                left = prose(3) + " https://www.example.com/" + pick(words) + "?" + pick(("", "page=2&", "user=ann&")) + name + "="
                right = pick((" ", "&page=2 ", "&lang=en ")) + prose(3)
        else:
            kind = int(rng.integers(9))
            if kind == 0:
                left, body, right = prose(3) + " " + pick(("commit ", "sha256:", "md5 ", "checksum: ", "digest=", "etag: ", "revision ")), chars(hexa, pick((32, 40, 64))), " " + prose(2)
            elif kind == 1:
                body = "-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12))
                left, right = prose(2) + " " + pick(("id = ", "uuid: ", "guid=", "request ")), " " + prose(2)
            elif kind == 2:
                body = "/".join(pick(words) for _ in range(int(rng.integers(3, 6))))
                left, right = prose(2) + pick((" /", " https://www.example.com/", " ./", " ")), pick((".html", ".png", "/", " ")) + prose(2)
            elif kind == 3:
                body = pick(("-", "_")).join(pick(words) for _ in range(int(rng.integers(3, 7))))
                left, right = prose(3) + pick((" ", " name: ", " class=", ' "')), " " + prose(2)
            elif kind == 4:
                body = "".join(pick(syllables) for _ in range(int(rng.integers(6, 14))))
                body = body if rng.random() < 0.7 else body.upper() if rng.random() < 0.5 else body.capitalize()
                left, right = prose(4) + " ", pick((" ", ", ", ". ", "!! ")) + prose(3)
            elif kind == 5:
                body, left, right = chars(num, pick((16, 16, 18, 20))), prose(4) + " ", " " + prose(3)
            elif kind == 6:
                body = pick(("x" * int(rng.integers(16, 40)), "your_api_key_here", "changeme_changeme", "example_token_value", "REPLACE_WITH_SECRET", "0" * 32, "-" * 20, "=" * 30, "insert-password-here"))
                left, right = prose(2) + " " + name + sign + quote, quote + " " + prose(2)
            elif kind == 7:
                body = "".join(pick(words).capitalize() for _ in range(int(rng.integers(3, 6))))
                left, right = prose(2) + pick((" new ", " import ", " class ", " ")), pick(("(", ".", " ")) + prose(2)
            else:
                body = pick(words) + pick(("", "_", "-")) + pick(words) + pick(("", "_id", "-name"))
                left, right = prose(2) + " " + name + sign, " " + prose(2)
        out.append((left + body + right, len(left), len(body), int(good)))
    for i in range(n // 2):  # public things of the same look, and secrets beside them
        prose = lambda k: " ".join("".join(pick(syllables) for _ in range(int(rng.integers(1, 5)))) for _ in range(k))
        size, quote, url = int(rng.integers(20, 90)), pick(('"', '"', "'")), b64 + "-_"
        wrapped = lambda head, first: f"{prose(2)}\n-----BEGIN {head}-----\n" + first + "".join(chars(b64, 64) + "\n" for _ in range(int(rng.integers(0, 24))))
        left, body, right, good = pick((
            lambda: (pick(('<img src="', "url(", "href='", prose(2) + " ")) + "data:" + pick(("image/png", "image/gif", "image/svg+xml", "font/woff2", "application/pdf", "text/plain;charset=utf-8")) + ";base64,", pick(("iVBORw0KGgo", "R0lGODlh", "/9j/", "PHN2Zy", "d09GMg", "")) + chars(b64, size + int(rng.integers(0, 200))), pick(('"', ")", "'", " ")) + prose(2), 0),
            lambda: (pick((f"integrity={quote}", f"{quote}integrity{quote}: {quote}", "integrity ", prose(2) + " ")), pick(("sha256-", "sha384-", "sha512-", "sha1-")) + chars(b64, pick((27, 43, 64, 86))) + pick(("=", "==", "")), quote + " crossorigin " + prose(1), 0),
            lambda: (prose(1) + pick((" ssh-rsa ", "\nssh-rsa ", " ssh-ed25519 ", " ecdsa-sha2-nistp256 ")), pick(("AAAAB3NzaC1yc2E", "AAAAC3NzaC1lZDI1NTE5", "AAAAE2VjZHNhLXNoYTItbmlzdHAyNTY")) + chars(b64, size + 40), pick((" ann@example.com", " user@host ", "\n")) + prose(2), 0),
            lambda: (wrapped(pick(("CERTIFICATE", "CERTIFICATE", "PUBLIC KEY", "CERTIFICATE REQUEST", "RSA PUBLIC KEY", "PGP SIGNATURE")), pick(("", "MII" + chars(b64, 61) + "\n"))), chars(b64, pick((64, 64, 64, int(rng.integers(16, 64))))), "\n" + pick(("", chars(b64, 64) + "\n")), 0),
            lambda: (prose(2) + " {" + quote + pick(("contentHash", "content_hash", "fileHash", "hash", "digest", "checksum", "bodyDigest", "sourceHash", "treeHash", "integrity")) + f"{quote}: {quote}", chars(b64, pick((22, 27, 43, 86))) + pick(("=", "==", "")), quote + pick(("}", ", ")) + prose(2), 0),
            lambda: (prose(2) + pick(("\nETag: ", " etag: ", " If-None-Match: ", " ETag=")) + pick(('"', 'W/"')), chars(pick((hexa, url, b64)), int(rng.integers(16, 44))), '"\n' + prose(2), 0),
            lambda: (prose(2) + pick((" ipfs://", " /ipfs/", " cid: ", " https://www.example.com/ipfs/", " ")), pick(("Qm" + chars(low + up + num, 44), "bafy" + chars(low + "234567", 55))), pick((" ", "/readme ", "\n")) + prose(2), 0),
            lambda: (prose(2) + pick((" https://www.example.com/playlist?list=", " https://www.example.com/watch?v=abc&list=", " playlist: ", " list=")), pick(("PL", "UU", "OL")) + chars(url.replace("+/", ""), pick((16, 22, 32))), pick((" ", "&index=2 ", "\n")) + prose(2), 0),
            lambda: (prose(1) + pick((' "mappings": "', ' "names":[],"mappings":"')), "".join(pick(("AAA", "CAC", "EAA", "GAI", "IAC", "SAA", "QAG")) + chars(up, 1) for _ in range(size // 2)), pick((",", ";")) + "AAAA", 0),
            lambda: (prose(2) + pick((" /assets/", " /static/js/", " main.", " bundle-", " chunk-")), pick(words) + pick(("-", ".", "_")).replace(".", "-") + chars(pick((hexa, low + num)), pick((16, 20, 32))), pick((".js", ".css", ".png", ".woff2")) + " " + prose(1), 0),
            lambda: (wrapped(pick(("PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY")), pick(("", "MII" + chars(b64, 61) + "\n"))), chars(b64, pick((64, 64, 64, int(rng.integers(20, 64))))), "\n" + pick(("", chars(b64, 64) + "\n")), 1),
            lambda: (prose(2) + pick((" Authorization: Bearer ", " authorization: Basic ", " -H 'Authorization: Bearer ", " Authorization: token ")), chars(pick((b64, url, hexa)), size) , pick(("\n", "' ", " ")) + prose(2), 1),
            lambda: (prose(2) + " {" + quote + pick(("clientSecret", "apiKey", "accessToken", "privateKey", "secretKey", "refresh_token", "password", "api_secret")) + f"{quote}: {quote}", chars(pick((b64, url, hexa, low + up + num)), size) + pick(("", "=", "==")), quote + pick(("}", ", ")) + prose(2), 1),
            lambda: (prose(1) + pick((" AccountKey=", " SharedAccessKey=", " account_key = ", " storage_key: ")), chars(b64, pick((43, 86))) + pick(("=", "==")), pick((";", " ", "\n")) + prose(2), 1),
            lambda: (prose(1) + pick((" export ", "\n", " ENV ")) + pick(("GITHUB_TOKEN=", "AWS_SECRET_ACCESS_KEY=", "DB_PASSWORD=", "STRIPE_SECRET=", "SESSION_SECRET=", "API_TOKEN=")), chars(pick((b64, low + up + num, url)), int(rng.integers(20, 60))), pick(("\n", " ")) + prose(2), 1),
        ))()
        out.append((left + body + right, len(left), len(body), good))
    return out


@dataclass
class Forest:
    """Trees as arrays of one layout: feature (-1 at a leaf), edge, left and right child, share of secrets; and the known words that features were measured with."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    known: Collection[str] = WORDS

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, edge, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (moving := feature[at] >= 0).any():
                rows = np.flatnonzero(moving)
                f = feature[at[rows]]
                low = x[rows, f] <= edge[at[rows]]
                at[rows] = np.where(low, left[at[rows]], right[at[rows]])
            total += share[at]
        return total / max(len(self.trees), 1)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 10, least: int = 4, seed: int = 5) -> Forest:
    """A random forest on bootstrap samples; at each node the best of up to 16 edges of sqrt(features) features, by Gini impurity."""
    rng = np.random.default_rng(seed)
    tries = max(2, math.isqrt(x.shape[1]))
    made = []
    for _ in range(trees):
        nodes: list[list] = []

        def node(rows: np.ndarray, level: int) -> int:
            at, mean = len(nodes), float(y[rows].mean())
            nodes.append([-1, 0.0, 0, 0, mean])
            if level == depth or len(rows) < 2 * least or mean in (0.0, 1.0):
                return at
            best = (2 * mean * (1 - mean) - 1e-6, -1, 0.0)
            for f in rng.choice(x.shape[1], tries, replace=False):
                v = x[rows, f]
                for edge in np.unique(np.quantile(v, np.linspace(0.03, 0.97, 16))):
                    low = v <= edge
                    k = int(low.sum())
                    if least <= k <= len(rows) - least:
                        p, q = y[rows[low]].mean(), y[rows[~low]].mean()
                        gini = (k * 2 * p * (1 - p) + (len(rows) - k) * 2 * q * (1 - q)) / len(rows)
                        if gini < best[0]:
                            best = (gini, int(f), float(edge))
            if best[1] >= 0:
                low = x[rows, best[1]] <= best[2]
                nodes[at][:2] = best[1], best[2]
                nodes[at][2] = node(rows[low], level + 1)
                nodes[at][3] = node(rows[~low], level + 1)
            return at

        node(rng.integers(0, len(y), len(y)), 0)
        feature, edge, left, right, share = zip(*nodes)
        made.append((np.array(feature), np.array(edge), np.array(left), np.array(right), np.array(share)))
    return Forest(made)


def _seen(text: str, start: int, length: int) -> tuple[int, int]:
    """The candidate that covers most of a labelled span, as a scan would judge it; the span itself if none meets it."""
    shared = lambda c: min(c[0] + c[1], start + length) - max(c[0], start)
    best = max(candidates(text), key=shared, default=(start, length))
    return best if shared(best) > 0 else (start, length)


def fit(findings: list[tuple[str, int, int, int]] | None = None, words: str | None = None) -> Forest:
    """Train on labelled findings (by default those of ``sample_findings``), each by the candidate that a scan finds there; ``words`` is the path of a ``dictionary``."""
    rows, known = findings if findings is not None else sample_findings(), dictionary(words) if words else WORDS
    forest = grow(np.array([describe(t, *_seen(t, s, n), known) for t, s, n, _ in rows]), np.array([float(y) for *_, y in rows]))
    return Forest(forest.trees, known)


def found(text: str, forest: Forest, threshold: float = 0.5) -> list[tuple[int, int, float]]:
    """``(start, length, score)`` of a whole text's candidates that the forest takes for secrets."""
    spans = candidates(text)
    if not spans:
        return []
    score = forest.score(np.array([describe(text, s, n, forest.known) for s, n in spans]))
    return [(s, n, float(p)) for (s, n), p in zip(spans, score) if p >= threshold]


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, length, finding, score)``: every finding in every whole text, in code points.

    Null and empty texts have none; repeated rows give their findings again; null ids are kept. Only the two named columns are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest or fit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, s, n, t[s : s + n], p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for s, n, p in found(t, shared.value, threshold)]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "start", "length", "finding", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, start long, length long, finding string, score double")


def redacted(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with each finding in ``text_col`` replaced by ``mark``; other columns, nulls and the order of columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or fit())
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        for s, n, _ in reversed(found(text, shared.value, threshold) if text else []):
            text = text[:s] + mark + text[s + n :]
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t.as_py()) for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)

