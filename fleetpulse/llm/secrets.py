"""Secret scans: fixed patterns plus strings that a primed compressor cannot shorten.

Three fixed patterns give the base spans.  Beyond them, a long run of key-like
characters in a sensitive context is measured by its marginal size: bytes of
the surrounding text with the run, less bytes without it, both compressed with
zstandard primed by a dictionary of ordinary code and identifiers.  A run that
costs nearly as much as its own characters carry is new to both, and reported;
with or without digits.

Defined cases: a null or empty text has no span and the hash of an empty list;
offsets count code points; equal starts keep the order of ``KINDS``; a run that
touches a base span is not reported twice; very long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_process, table, text_column

KINDS = ("assign", "access", "hex", "novel")
FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 16
HEX = re.compile(r"[0-9a-f]+")
HEX_LEAST = 32
_HEX_TO_X = bytes(ord("x") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))

#: What makes the text before a run sensitive, and how far before it.
SENSITIVE = re.compile(r"(?i:passw|pwd|secret|token|api[_ -]?key|private|credential|auth|bearer|access[_ -]?key)", re.ASCII)
REACH = 48
#: Every sensitive context holds one of these.
HINTS = ("passw", "pwd", "secret", "token", "api", "private", "credential", "auth", "bearer", "access")
#: Runs worth measuring: key-like characters.  An inner "=" parts a key name
#: from its value, so "=" belongs to a run only as padding at its end.
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: Characters of surrounding text that the compressor sees on either side.
AROUND = 256
#: Least marginal bytes per character.  Of 1,000 random runs of each kind (hex, base62, letters of one or both cases),
#: length (16, 24, 31) and place (short text, prose, env file) at most 1 costs less; the least hex run costs 0.75, the
#: least base62 run 0.69, the least lower-case run 0.5.  Runs joined from common words and identifiers cost 0.14 to 0.7.
NOVELTY = 0.55

PRIMER = " ".join(
    """
    the and that with this from have they which their there would about other when what some than them into only more
    over such even most after also made many before must through where much your well down should because each just
    those people how too little state good very make world still own see men work long get here between both life
    being under never day same another know while last might great old year off come since against go came right used
    take three himself few house use during without again place american around however home small found thought went
    say part once general high upon school every does got united left number course war until always away something
    fact water less public put think almost hand enough far took head yet government system better set told nothing
    night end why called eyes find going look asked later knew point next program city business give group toward
    young days let room word present given second order along possible national early means form action process
    information authentication authorization application administration environment implementation configuration
    connection collection function operation transaction validation verification registration permission session
    version exception description expression extension dimension decision condition position addition edition
    middleware factory manager handler controller service provider client server database repository component
    interface abstract instance object property attribute method parameter argument variable constant operator
    generate create update remove insert select request response header cookie content length character string
    number integer boolean double float array list queue stack table column index primary foreign unique default
    password username account customer address payment invoice product shipping message notification template
    directory filename extension separator document reference resource location encoding decoding encrypted
    signature certificate private public secure security access refresh expires expired invalid missing required
    storage bucket region cluster container deployment namespace kubernetes docker service account policy role
    getAccessToken setPassword isAuthenticated hasPermission toString valueOf createUser deleteUser findById
    AccessToken RefreshToken ClientSecret UserName PassWord PrivateKey PublicKey SecretKey HttpClient
    ACCESS_KEY SECRET_KEY PRIVATE_KEY DATABASE_URL DATABASE_PASSWORD AUTH_TOKEN CLIENT_SECRET CLIENT_ID
    SESSION_SECRET AWS_SECRET_ACCESS_KEY AWS_ACCESS_KEY_ID GITHUB_TOKEN API_TOKEN
    usr local etc opt var lib share bin home src main java python node_modules packages vendor
    import from return class def self None True False function const let var public private static void string int
    http https www com org net index html json yaml config settings default user username name value key id data
    password passwd secret token api_key apikey auth bearer authorization access credential private_key client_id
    client_secret session cookie header request response localhost example test production staging environment
    export set get put post delete update insert select where order group limit offset 0123456789 1234567890
    ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 00000000 11111111 2020-01-01 2021-01-01 2022-01-01
    2023-01-01 2024-01-01 2025-01-01 EXAMPLE CHANGEME placeholder your_token_here your-api-key-here xxxxxxxxxxxxxxxx
    """.split()
).encode()
#: Ordinary prose before every text, so that letters have the code lengths of prose in short texts too.
PROSE = (
    "The service reads its settings when it starts and keeps them until the next restart. Every user of the account has a"
    " name and a role, and the administrator can change both. If the password is lost, ask for another one; the old one"
    " stops working at once. We keep a copy of the change for a day, and then it is removed from the store. Nothing else"
    " has to be done by the client. "
)


def _compressor() -> zstandard.ZstdCompressor:
    primer = zstandard.ZstdCompressionDict(PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primer, write_checksum=False, write_content_size=False)


def marginal_bytes(run: str, before: str, after: str) -> int:
    """Compressed bytes that ``run`` adds to its surroundings."""
    size = per_process("secret compressor", _compressor).compress
    around = PROSE + before + after
    return len(size((around + run).encode())) - len(size(around.encode()))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, kinds by their place in ``KINDS``."""
    spans = []
    lower = text.lower()
    if any(w in lower for w in ("passw", "secret", "token", "api")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if b"x" * HEX_LEAST in text.encode().translate(_HEX_TO_X):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(spans)


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs in a sensitive context that the primed compressor cannot shorten and no base span touches."""
    lower = text.lower()
    if not any(w in lower for w in HINTS):
        return []
    found = []
    for m in RUN.finditer(text):
        a, b = m.span()
        if any(s < b and a < e for s, _, e in base):
            continue
        if SENSITIVE.search(text, max(0, a - REACH), a):
            cost = marginal_bytes(m[0], text[max(0, a - AROUND) : a], text[b : b + AROUND])
            if cost >= NOVELTY * (b - a):
                found.append((a, 3, b))
    return found


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str) -> tuple:
    """The fields of ``FOUND``."""
    base = base_spans(text)
    new = novel_spans(text, base)
    count = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    digest = hashlib.sha256(listed(base).encode()).hexdigest()
    return (*count, digest, listed(sorted(base + new)), len(new))


def redact(text: str, mark: str = "[REDACTED]") -> str:
    """``text`` with every span, overlapping ones joined, replaced by ``mark``."""
    base = base_spans(text)
    out, kept_from = [], 0
    for a, _, b in sorted(base + novel_spans(text, base)):
        if a >= kept_from:
            out += [text[kept_from:a], mark]
        kept_from = max(kept_from, b)
    return "".join(out) + text[kept_from:]


def secrets(text: Column) -> Column:
    return text_column(FOUND, scan, text)


def redacted(text: Column) -> Column:
    """Text without its secrets; null stays null."""
    clean = text_column("text string", lambda x: (redact(x),), text)["text"]
    return F.when(text.isNotNull(), clean)


def secret_scans(docs: DataFrame) -> DataFrame:
    """doc_id and ``FOUND`` for every row of ``docs``."""
    return docs.select("doc_id", secrets(F.col("text")).alias("s")).select("doc_id", "s.*")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans(table(spark, sf_dir, "documents"))
