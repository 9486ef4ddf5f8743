"""Name scalars: splitting, case style, phonetic code, bigrams, dictionary expansion, base-63 ids.

Splitter A keeps acronyms (`HTTPServer` -> http, server); splitter B of the index meant the same and is
served by A.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default dictionary entries that results must agree on; more are a parameter.
ABBREVIATIONS = {
    "auth": ["authenticate", "authorization", "authorized", "login", "signin"],
    "auth0": ["authentication", "authorization"],
    "oauth": ["oauth", "authorization", "framework"],
    "jwt": ["json", "web", "token"],
    "sso": ["single", "sign", "on"],
    "mfa": ["multi", "factor", "authentication"],
    "ldap": ["lightweight", "directory", "access", "protocol"],
    "api": ["application", "programming", "interface"],
    "rest": ["representational", "state", "transfer"],
    "graphql": ["graphql", "query", "language"],
    "grpc": ["grpc", "remote", "procedure", "call"],
    "rpc": ["remote", "procedure", "call"],
    "webhook": ["webhook", "callback"],
    "db": ["database", "databases"],
    "sql": ["structured", "query", "language"],
    "orm": ["object", "relational", "mapping"],
    "dao": ["data", "access", "object"],
    "dto": ["data", "transfer", "object"],
    "repo": ["repository", "repositories"],
    "cache": ["caching", "cached"],
    "redis": ["redis", "cache"],
    "nosql": ["nosql", "database"],
    "mongodb": ["mongodb", "document", "database"],
    "io": ["input", "output"],
    "fs": ["filesystem", "file", "system"],
    "path": ["filepath", "pathname"],
    "dir": ["directory"],
    "tmp": ["temporary"],
    "http": ["hypertext", "transfer", "protocol"],
    "https": ["hypertext", "transfer", "protocol", "secure"],
    "tcp": ["transmission", "control", "protocol"],
    "udp": ["user", "datagram", "protocol"],
    "dns": ["domain", "name", "system"],
    "tls": ["transport", "layer", "security"],
    "ssl": ["secure", "sockets", "layer"],
    "cert": ["certificate"],
    "pem": ["privacy", "enhanced", "mail"],
    "ui": ["user", "interface"],
    "ux": ["user", "experience"],
    "html": ["hypertext", "markup", "language"],
    "css": ["cascading", "style", "sheets"],
    "dom": ["document", "object", "model"],
    "spa": ["single", "page", "application"],
    "ssr": ["server", "side", "rendering"],
    "csr": ["client", "side", "rendering"],
    "pwa": ["progressive", "web", "application"],
    "ci": ["continuous", "integration"],
    "cd": ["continuous", "deployment"],
    "devops": ["devops", "development", "operations"],
    "kubernetes": ["kubernetes", "container", "orchestration"],
    "k8s": ["kubernetes"],
    "docker": ["docker", "container"],
    "container": ["container", "containerization"],
    "vm": ["virtual", "machine"],
    "vcs": ["version", "control", "system"],
    "git": ["git", "version", "control"],
    "svn": ["subversion", "version", "control"],
    "test": ["testing", "unit", "test"],
    "tst": ["test", "testing"],
    "unit": ["unit", "test"],
    "e2e": ["end", "to", "end"],
    "bdd": ["behavior", "driven", "development"],
    "tdd": ["test", "driven", "development"],
    "crud": ["create", "read", "update", "delete"],
    "lint": ["linting", "code", "quality"],
    "coverage": ["code", "coverage", "test"],
    "id": ["identifier", "identity"],
    "uuid": ["universally", "unique", "identifier"],
    "guid": ["globally", "unique", "identifier"],
    "oid": ["object", "identifier"],
    "cli": ["command", "line", "interface"],
    "gui": ["graphical", "user", "interface"],
    "url": ["uniform", "resource", "locator"],
    "uri": ["uniform", "resource", "identifier"],
    "mime": ["multipurpose", "internet", "mail", "extensions"],
    "json": ["javascript", "object", "notation"],
    "xml": ["extensible", "markup", "language"],
    "yaml": ["yaml", "data", "serialization"],
    "csv": ["comma", "separated", "values"],
    "regex": ["regular", "expression"],
    "utf": ["unicode", "transformation", "format"],
    "ascii": ["american", "standard", "code", "information", "interchange"],
    "base64": ["base64", "encoding"],
    "hash": ["hashing", "hash", "function"],
    "md5": ["md5", "hash"],
    "sha": ["sha", "hash"],
    "bcrypt": ["bcrypt", "password", "hashing"],
    "log": ["logging", "log"],
    "metric": ["metrics", "metric"],
    "trace": ["tracing", "distributed", "trace"],
    "profile": ["profiling", "performance"],
    "benchmark": ["benchmark", "performance", "test"],
    "timeout": ["timeout", "time", "limit"],
    "retry": ["retry", "attempt"],
    "queue": ["queue", "message", "queue"],
    "stream": ["stream", "streaming"],
    "event": ["event", "event", "driven"],
    "listener": ["listener", "observer"],
    "handler": ["handler", "callback"],
    "middleware": ["middleware", "interceptor"],
    "plugin": ["plugin", "extension"],
    "lib": ["library", "libraries"],
    "pkg": ["package"],
    "mod": ["module"],
    "vendor": ["vendor", "vendoring"],
    "deps": ["dependencies", "dependency"],
    "lock": ["lockfile", "dependency", "lock"],
    "idx": ["index"],
    "cnt": ["count"],
    "len": ["length"],
    "str": ["string"],
    "num": ["number"],
    "val": ["value"],
    "cfg": ["config", "configuration"],
    "prod": ["production"],
    "dist": ["distribution", "distribute"],
    "temp": ["temporary"],
    "avg": ["average"],
    "min": ["minimum"],
    "max": ["maximum"],
    "err": ["error"],
    "msg": ["message"],
    "req": ["request"],
    "resp": ["response"],
    "res": ["response", "result", "resource"],
    "async": ["asynchronous"],
    "util": ["utility", "utilities"],
    "app": ["application"],
    "obj": ["object"],
    "arr": ["array"],
    "ptr": ["pointer"],
    "ref": ["reference"],
    "txn": ["transaction"],
    "conn": ["connection"],
    "mgr": ["manager"],
    "svc": ["service"],
    "ctx": ["context"],
    "param": ["parameter"],
    "arg": ["argument"],
    "func": ["function"],
    "var": ["variable"],
    "const": ["constant"],
    "env": ["environment"],
    "dev": ["development"],
    "impl": ["implementation"],
    "i": ["index", "iterator"],
    "j": ["index", "iterator"],
    "k": ["index", "iterator", "key"],
    "v": ["value"],
    "n": ["number", "count"],
    "x": ["value", "variable"],
    "y": ["value", "variable"],
    "z": ["value", "variable"],
    "g": ["global"],
    "s": ["static"],
    "m": ["member"],
}
#: Abbreviations that also answer to their long form.
REVERSIBLE = ("cfg", "ctx", "mgr", "svc", "req", "resp", "msg", "db", "auth")
DOMAINS = {
    "authentication": ["signin", "login", "authenticate", "verify", "authorize", "auth"],
    "authorization": ["permission", "access", "role", "grant", "deny"],
    "user": ["user", "account", "member", "customer", "profile", "identity"],
    "persistence": ["store", "save", "persist", "repository", "database", "cache"],
    "creation": ["factory", "builder", "construct", "create", "instantiate", "new"],
    "error-handling": ["error", "exception", "failure", "fault", "recovery", "catch"],
    "communication": ["send", "transmit", "emit", "publish", "dispatch", "notify"],
    "retrieval": ["fetch", "get", "retrieve", "load", "query", "find"],
    "deletion": ["delete", "remove", "purge", "destroy", "drop"],
    "sorting": ["sort", "order", "rank", "arrange"],
}
SOUNDS = {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}
BASE63 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"


def _boundaries(c: Column) -> Column:
    """A space at each camel-case, acronym and digit boundary."""
    c = F.regexp_replace(c, r"([\p{Ll}])([\p{Lu}])", "$1 $2")
    c = F.regexp_replace(c, r"([\p{Lu}])([\p{Lu}][\p{Ll}])", "$1 $2")
    c = F.regexp_replace(c, r"([\p{L}])([0-9])", "$1 $2")
    return F.regexp_replace(c, r"([0-9])([\p{L}])", "$1 $2")


def split(name: Column) -> Column:
    """Splitter A: `_ - . /`, spaces, camel case, acronyms and digits; lower-cased."""
    return F.filter(F.split(F.lower(_boundaries(F.regexp_replace(name, r"[_\-./\s]+", " "))), " +"), lambda x: x != "")


def terms(name: Column) -> Column:
    """Splitter C: words of three letters or more."""
    return F.filter(split(name), lambda x: F.char_length(x) >= 3)


def camel(name: Column) -> Column:
    """Splitter D: camel case and acronyms, case kept."""
    c = F.regexp_replace(F.regexp_replace(name, r"([\p{Ll}0-9])([\p{Lu}])", "$1 $2"), r"([\p{Lu}])([\p{Lu}][\p{Ll}])", "$1 $2")
    return F.filter(F.split(c, " +"), lambda x: x != "")


def case_style(name: Column) -> Column:
    return (
        F.when(name.rlike("^[a-z0-9]+(_[a-z0-9]+)+$"), "snake")
        .when(name.rlike("^[A-Z0-9]+(_[A-Z0-9]+)+$"), "screaming")
        .when(name.rlike("^[a-z0-9]+(-[a-z0-9]+)+$"), "kebab")
        .when(name.rlike("^[A-Z][A-Za-z0-9]*[a-z][A-Za-z0-9]*$"), "pascal")
        .when(name.rlike("^[a-z][a-z0-9]*[A-Z][A-Za-z0-9]*$"), "camel")
        .otherwise("unknown")
    )


def phonetic(name: Column) -> Column:
    """The first character, lower-cased, and three digits; other letters separate equal digits."""
    low = F.lower(name)
    rest = F.substring(low, F.lit(2), F.char_length(low))
    for digit, letters in SOUNDS.items():
        rest = F.regexp_replace(rest, f"[{letters}]", digit)
    rest = F.regexp_replace(F.regexp_replace(rest, "[^1-6]", "0"), r"([1-6])\1+", "$1")
    digits = F.regexp_replace(rest, "0", "")
    return F.when(name == "", "").otherwise(F.rpad(F.concat(F.substring(low, 1, 1), F.substring(digits, 1, 3)), 4, "0"))


def bigrams(name: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    n = F.char_length(name)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(2)))))


def bigram_cosine(a: Column, b: Column) -> Column:
    x, y = bigrams(a), bigrams(b)
    return F.when(a == b, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.sqrt(F.size(x) * F.size(y).cast("double")))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length."""
    most = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / most)


def _map(pairs: dict) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def expand(term: Column, abbreviations: dict | None = None, domains: dict | None = None) -> Column:
    """The term, its long forms, its short forms, and its peers in each domain; distinct, in that order."""
    abbreviations, domains = abbreviations or ABBREVIATIONS, domains or DOMAINS
    short: dict[str, list[str]] = {}
    for k in abbreviations:
        if k in REVERSIBLE:
            for w in abbreviations[k]:
                short.setdefault(w, []).append(k)
    peers: dict[str, list[str]] = {}
    for words in domains.values():
        for w in words:
            peers.setdefault(w, []).extend(x for x in words if x != w and x not in peers.get(w, []))
    none = F.array().cast("array<string>")
    look = lambda m: F.coalesce(F.try_element_at(_map(m), term), none)
    return F.array_distinct(F.concat(F.array(term), look(abbreviations), look(short), look(peers)))


def expand_words(words: Column, abbreviations: dict | None = None) -> Column:
    """Each word, followed by its long forms."""
    none = F.array().cast("array<string>")
    table = _map(abbreviations or ABBREVIATIONS)
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.try_element_at(table, w), none))))


def encode63(n: Column) -> Column:
    """Base-63 text of a number, most significant digit first; zero is the first letter."""
    digits = F.array(*map(F.lit, BASE63))
    powers = F.array(*[F.call_function("div", n.cast("long"), F.lit(63**i)) for i in range(11)])
    text = F.reverse(F.array_join(F.transform(powers, lambda p: F.element_at(digits, (p % 63 + 1).cast("int"))), ""))
    out = F.regexp_replace(text, "^A+", "")
    return F.when(out == "", "A").otherwise(out)


def composite_id(file_id: Column, local: Column) -> Column:
    return encode63(file_id + F.shiftleft(local.cast("long"), 32))


def decode63(text: Column) -> Column:
    """The number of a base-63 text; null if a character is foreign."""
    digit = lambda c: (F.instr(F.lit(BASE63), c) - 1).cast("long")
    value = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: acc * 63 + digit(c))
    return F.when(text.rlike("^[A-Za-z0-9_]+$"), value)
