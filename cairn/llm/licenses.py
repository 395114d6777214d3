"""Scan of texts for licence statements (operator 4).

Ordered signature rules over the words of a text. A rule is a pattern with the words it cannot match without (its
keywords), a label, a priority and a confidence. A rule is tried only on texts that hold all its keywords. Where detections
overlap, one that lies within a detection of a higher priority (or of the same and longer, or as long and listed earlier)
is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cairn.llm.shared import slices

# The contract's words and base phrases with their labels.
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Priority by how much a rule says: a full statement or address, a name with its version, a name, a hint.
STATEMENT, VERSIONED, NAMED, HINT = 40, 30, 20, 10
CONFIDENCE = {STATEMENT: 0.99, VERSIONED: 0.95, NAMED: 0.85, HINT: 0.5}
LICENSE = "licen[cs]e"


class Rule(NamedTuple):
    label: str
    pattern: re.Pattern
    keywords: tuple[frozenset[str], ...]
    priority: int


def _rule(label: str, pattern: str, keywords: str, priority: int) -> Rule:
    """keywords: words all needed, alternatives with a bar. The pattern matches whole words of a text joined by spaces."""
    return Rule(label, re.compile(f"(?<= ){pattern}(?= )"), tuple(frozenset(k.split("|")) for k in keywords.split()), priority)


def _version(v: str) -> str:
    major, _, minor = v.partition(".")
    return f"v?{major}" + (f"(?: {minor})?" if minor == "0" or not minor else f" {minor}")


EITHER = "license|licence|licenses|licences"
#: Rules written one by one: label, pattern over words, keywords, priority.
HAND = (
    ("0bsd", "(?:bsd zero clause|zero clause bsd)", "zero clause bsd", VERSIONED),
    ("afl", "academic free licen[cs]es?", "academic free", NAMED),
    ("aladdin", "aladdin free public licen[cs]e", "aladdin public", NAMED),
    ("amazon-sl", "amazon software licen[cs]e", f"amazon software {EITHER}", NAMED),
    ("apache", "(?:under|see) (?:the )?apache licen[cs]e for", f"apache {EITHER}", NAMED),
    ("apache-2.0", "you may not use this file except in compliance with the license", "compliance except", NAMED),
    ("apple-psl", "apple public source licen[cs]e(?: version)?(?: [0-9])?", "apple public source", NAMED),
    ("artistic", "same terms as perl itself", "perl terms itself", NAMED),
    ("blueoak-1.0.0", "blue oak model licen[cs]e(?: 1 0 0)?", "blue oak model", VERSIONED),
    ("boost", "boost org license 1 0 txt", "boost org", STATEMENT),
    ("bsd", "neither the name of .{1,80} nor the names of its contributors may be used to endorse", "neither contributors endorse", STATEMENT),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions retain", STATEMENT),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions reproduce", STATEMENT),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "advertising materials", STATEMENT),
    ("bsd-protection", "bsd protection licen[cs]e", "bsd protection", NAMED),
    ("busl-1.1", "business source licen[cs]e(?: version)?(?: 1 1)?", "business source", VERSIONED),
    ("bzip2", "bzip2(?: and libbzip2)? licen[cs]e", f"bzip2 {EITHER}", NAMED),
    ("caldera", "caldera licen[cs]e", f"caldera {EITHER}", NAMED),
    ("cc-pdm-1.0", "creativecommons org publicdomain mark 1 0", "creativecommons publicdomain mark", STATEMENT),
    ("cecill", "cecill(?: [abc])?(?: free software)?(?: licen[cs]e)?(?: agreement)?", "cecill", NAMED),
    ("cern-ohl", "cern open hardware licen[cs]e(?: version)?(?: [12](?: [0-9])?)?", "cern hardware", VERSIONED),
    ("clear-bsd", "clear bsd licen[cs]e", f"clear bsd {EITHER}", VERSIONED),
    ("commons-clause", "commons clause(?: licen[cs]e)? condition", "commons clause condition", STATEMENT),
    ("confluent", "confluent community licen[cs]e", f"confluent community {EITHER}", NAMED),
    ("copyleft-next", "copyleft next(?: 0 3 [01])?", "copyleft next", NAMED),
    ("copyright", "copyright by the authors?", "copyright authors|author", HINT),
    ("cpal-1.0", "common public attribution licen[cs]e", "common public attribution", VERSIONED),
    ("crossword", "crossword licen[cs]e", f"crossword {EITHER}", NAMED),
    ("cua-opl", "cua office public licen[cs]e", "cua office public", NAMED),
    ("curl", "curl licen[cs]e", f"curl {EITHER}", NAMED),
    ("d-fsl", "german free software licen[cs]e", "german free software", NAMED),
    ("dbad", "don t be a dick public licen[cs]e", "dick public", NAMED),
    ("dual", "(?:dual|doubly) licensed under", "licensed dual|doubly", HINT),
    ("ecl", "educational community licen[cs]es?", "educational community", NAMED),
    ("efl", "eiffel forum licen[cs]e", "eiffel forum", NAMED),
    ("elastic-2.0", "elastic licen[cs]e(?: version)?(?: 2 0)?", f"elastic {EITHER}", VERSIONED),
    ("entessa", "entessa public licen[cs]e", "entessa public", NAMED),
    ("etalab", "licence ouverte(?: etalab)?", "ouverte licence", NAMED),
    ("eula", "end user licen[cs]e agreement", f"user agreement {EITHER}", NAMED),
    ("fair", "usage of the works is permitted provided that this instrument is retained", "usage instrument retained", STATEMENT),
    ("frameworx", "frameworx open licen[cs]e", "frameworx open", NAMED),
    ("freeimage", "freeimage public licen[cs]e", "freeimage public", NAMED),
    ("ftl", "freetype (?:project )?licen[cs]e", f"freetype {EITHER}", NAMED),
    ("gfdl", "gnu free documentation licen[cs]e(?: version 1 [123])?", "gnu free documentation", VERSIONED),
    ("glide", "3dfx glide source code general public licen[cs]e", "3dfx glide", NAMED),
    ("gpl", "you should have received a copy of the gnu general public license", "received gnu public", STATEMENT),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", "merchantability gnu fitness", STATEMENT),
    ("gpl-exception", "(?:classpath|linking|runtime library|autoconf|bison) exception", "exception classpath|linking|runtime|autoconf|bison", HINT),
    ("gsoap", "gsoap public licen[cs]e", "gsoap public", NAMED),
    ("hippocratic", "hippocratic licen[cs]e", "hippocratic", NAMED),
    ("hpnd", "historical permission notice and disclaimer", "historical permission disclaimer", NAMED),
    ("ibm-pl", "ibm public licen[cs]e", "ibm public", NAMED),
    ("icu", "(?:icu|unicode icu) licen[cs]e", f"icu {EITHER}", NAMED),
    ("ijg", "independent jpeg group", "independent jpeg group", NAMED),
    ("imagemagick", "imagemagick licen[cs]e", f"imagemagick {EITHER}", NAMED),
    ("info-zip", "info zip licen[cs]e", f"info zip {EITHER}", NAMED),
    ("intel", "intel open source licen[cs]e", "intel open source", NAMED),
    ("ipa", "ipa font licen[cs]e", "ipa font", NAMED),
    ("jasper", "jasper licen[cs]e", f"jasper {EITHER}", NAMED),
    ("json", "the software shall be used for good not evil", "software good evil", STATEMENT),
    ("lal", "(?:licence art libre|free art licen[cs]e)", "art libre|free", NAMED),
    ("libpng", "libpng licen[cs]e", f"libpng {EITHER}", NAMED),
    ("libtiff", "libtiff licen[cs]e", f"libtiff {EITHER}", NAMED),
    ("liliq", "licence libre du québec", "libre québec", NAMED),
    ("linux-openib", "openib org bsd licen[cs]e", "openib bsd", NAMED),
    ("llama", "llama(?: [0-9](?: [0-9])?)? community licen[cs]e", "llama community", VERSIONED),
    ("lucent", "lucent public licen[cs]e", "lucent public", NAMED),
    ("miros", "miros licen[cs]e", f"miros {EITHER}", NAMED),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", "permission notice copies", STATEMENT),
    ("mit", "the software is provided as is without warranty of any kind express or implied including", "software warranty kind", STATEMENT),
    ("mit-0", "mit no attribution", "mit attribution", VERSIONED),
    ("motosoto", "motosoto open source licen[cs]e", "motosoto open", NAMED),
    ("mpl-2.0", "mozilla org mpl 2 0", "mozilla mpl", STATEMENT),
    ("ms-pl", "microsoft public licen[cs]e", "microsoft public", NAMED),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "microsoft reciprocal", NAMED),
    ("mulan-psl", "mulan permissive software licen[cs]e(?: v ?[12])?", "mulan permissive", VERSIONED),
    ("naist", "naist licen[cs]e", f"naist {EITHER}", NAMED),
    ("nasa", "nasa open source agreement", "nasa open agreement", NAMED),
    ("naumen", "naumen public licen[cs]e", "naumen public", NAMED),
    ("nethack", "nethack general public licen[cs]e", "nethack public", NAMED),
    ("netscape", "netscape public licen[cs]e", "netscape public", NAMED),
    ("nokia", "nokia open source licen[cs]e", "nokia open source", NAMED),
    ("non-commercial", "for non ?commercial (?:use|purposes) only", "only use|purposes", NAMED),
    ("non-commercial", "non ?commercial research (?:use|purposes)", "research use|purposes", NAMED),
    ("npl", "non profit open software licen[cs]e", "profit open software", NAMED),
    ("nposl-3.0", "non profit osl 3 0", "profit osl", VERSIONED),
    ("odbl-1.0", "open database licen[cs]e(?: 1 0)?", "open database", VERSIONED),
    ("odc-by-1.0", "open data commons attribution licen[cs]e", "open commons attribution", VERSIONED),
    ("ogl-uk", "open government licen[cs]e(?: v ?[123](?: 0)?)?", "open government", VERSIONED),
    ("oldap", "openldap public licen[cs]e(?: version)?(?: [12](?: [0-9])?)?", "openldap public", VERSIONED),
    ("open-rail", "(?:creativeml )?open ?rail(?: ?[msd])?(?: licen[cs]e)?", "openrail|openrailm|openrails|openraild|rail|railm|rails|raild", NAMED),
    ("openssl", "this product includes software developed by the openssl project", "openssl project", STATEMENT),
    ("oracle-bcl", "oracle binary code licen[cs]e agreement", "oracle binary code", NAMED),
    ("otn", "oracle technology network licen[cs]e", "oracle technology network", NAMED),
    ("parity", "parity public licen[cs]e(?: [67](?: 0)?)?", "parity public", NAMED),
    ("patent", "(?:patents? pending|protected by (?:us )?patents?)", "patent|patents", HINT),
    ("pddl-1.0", "public domain dedication and licen[cs]e", "public dedication", VERSIONED),
    ("php", "php net license 3 0[01] txt", "php license", STATEMENT),
    ("polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) licen[cs]e", "polyform", VERSIONED),
    ("postgresql", "postgresql licen[cs]e", f"postgresql {EITHER}", NAMED),
    ("proprietary", "all information contained herein is and remains the property of", "information herein property", STATEMENT),
    ("proprietary", "confidential and proprietary information of", "confidential proprietary information", STATEMENT),
    ("proprietary", "do not distribute without(?: prior)?(?: written)? permission", "distribute permission", NAMED),
    ("proprietary", "for internal use only", "internal only", NAMED),
    ("proprietary", "licensed materials property of", "licensed materials property", STATEMENT),
    ("prosperity", "prosperity public licen[cs]e", "prosperity public", NAMED),
    ("psf-2.0", "psf licen[cs]e agreement(?: for python)?(?: 2)?", "psf agreement", VERSIONED),
    ("public-domain", "no copyright is claimed", "copyright claimed", NAMED),
    ("public-domain", "the authors? disclaims? copyright to this source code", "disclaims|disclaim copyright", STATEMENT),
    ("python", "same licen[cs]e as python", "python same", NAMED),
    ("qpl-1.0", "q public licen[cs]e(?: version)?(?: 1 0)?", "q public", VERSIONED),
    ("radiance", "radiance software licen[cs]e", "radiance software", NAMED),
    ("reserved", "all other rights reserved", "rights reserved", NAMED),
    ("reserved", "tutti i diritti riservati", "diritti riservati", NAMED),
    ("reserved", "todos os direitos reservados", "direitos reservados", NAMED),
    ("reserved", "alle rechten voorbehouden", "rechten voorbehouden", NAMED),
    ("rpl-1.5", "reciprocal public licen[cs]e(?: 1 [135])?", "reciprocal public", VERSIONED),
    ("ruby", "(?:ruby licen[cs]e|licen[cs]e of ruby|ruby s licen[cs]e)", f"ruby {EITHER}", NAMED),
    ("sax-pd", "sax public domain notice", "sax public notice", NAMED),
    ("sgi-b-2.0", "sgi free software licen[cs]e b(?: version)?(?: 2 0)?", "sgi free software", VERSIONED),
    ("simple-pl", "simple public licen[cs]e(?: 2 0)?", "simple public", NAMED),
    ("sissl", "sun industry standards source licen[cs]e", "sun industry standards", NAMED),
    ("sleepycat", "sleepycat licen[cs]e", f"sleepycat {EITHER}", NAMED),
    ("spl-1.0", "sun public licen[cs]e(?: version)?(?: 1 0)?", "sun public", VERSIONED),
    ("sspl-1.0", "server side public licen[cs]e(?: version)?(?: 1)?", "server side public", VERSIONED),
    ("stackexchange", "user contributions licensed under", "user contributions licensed", HINT),
    ("tcl", "tcl tk licen[cs]e", f"tcl {EITHER}", NAMED),
    ("tou", "terms of (?:use|service) apply", "terms apply use|service", HINT),
    ("trademark", "(?:is|are) (?:a )?(?:registered )?trademarks? of", "trademark|trademarks", HINT),
    ("unicode", "unicode (?:inc )?licen[cs]e agreement", "unicode agreement", NAMED),
    ("unlicense", "unlicense org", "unlicense org", STATEMENT),
    ("vim", "vim licen[cs]e", f"vim {EITHER}", NAMED),
    ("vovida", "vovida software licen[cs]e", "vovida software", NAMED),
    ("vsl", "vita nuova liberal source licen[cs]e", "vita nuova", NAMED),
    ("w3c", "w3c software (?:notice and )?(?:and document )?licen[cs]e", "w3c software", NAMED),
    ("watcom", "sybase open watcom public licen[cs]e", "sybase watcom", NAMED),
    ("wxwindows", "wxwindows library licen[cs]e", "wxwindows library", NAMED),
    ("xnet", "x net licen[cs]e", f"net x {EITHER}", NAMED),
    ("zend", "zend (?:engine )?licen[cs]e", f"zend {EITHER}", NAMED),
    ("zimbra", "zimbra public licen[cs]e", "zimbra public", NAMED),
    ("zlib", "altered source versions must be plainly marked as such", "altered plainly marked", STATEMENT),
    ("zlib", "the origin of this software must not be misrepresented", "origin misrepresented", STATEMENT),
)


@cache
def rules() -> tuple[Rule, ...]:
    """The rules in order: those of families with many versions are made from their forms of words, others stand in HAND."""
    out: list[Rule] = []
    either = "license|licence|licenses|licences"
    # GNU licences: each version, by name, by abbreviation, "or later" and "only", by address
    gnu = (("gpl", "gnu general public license", "(?:the )?(?:gnu )?general public", "general|gnu public", ("1.0", "2.0", "3.0")), ("lgpl", "gnu lesser general public license", "(?:the )?(?:gnu )?(?:lesser|library) general public", "lesser|library general public", ("2.0", "2.1", "3.0")), ("agpl", "gnu affero general public license", "(?:the )?(?:gnu )?affero general public", "affero general public", ("1.0", "3.0")))
    for short, _, name, keys, versions in gnu:
        for v in versions:
            n = _version(v)
            out += [
                _rule(f"{short}-{v}-or-later", f"{name} {LICENSE}(?: as published by the free software foundation)?(?: either)? version {n}(?: of the {LICENSE})? or (?:at your option )?any later version", f"{keys} {either} later", STATEMENT),
                _rule(f"{short}-{v}-only", f"{name} {LICENSE} version {n} only", f"{keys} {either} only", STATEMENT),
                _rule(f"{short}-{v}", f"gnu org licenses (?:old licenses )?{short} {n}(?: (?:html|txt))?", f"gnu org licenses {short}", STATEMENT),
                _rule(f"{short}-{v}", f"{name} {LICENSE}(?: as published by the free software foundation)? (?:version )?{n}", f"{keys} {either}", VERSIONED),
                _rule(f"{short}-{v}", f"version {n} of {name} {LICENSE}", f"{keys} {either} version", VERSIONED),
                _rule(f"{short}-{v}-or-later", f"{short} {n} or later", f"{short} or later", STATEMENT),
                _rule(f"{short}-{v}-only", f"{short} {n} only", f"{short} only", STATEMENT),
                _rule(f"{short}-{v}", f"(?:{short} (?:version )?{n}|{short}v{n[2:]})", f"{short}|{short}v{v[0]}", VERSIONED),
            ]
        out += [_rule(short, f"{name} {LICENSE}", f"{keys} {either}", NAMED), _rule(short, f"(?:gnu {short}|{short} {LICENSE}|licensed under (?:the )?{short})", short, NAMED), _rule(short, short, short, HINT)]
    # Creative Commons: each licence and version, by name, by abbreviation, by address
    parts = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|ative work)?s?"}
    for code in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        letters = code.split("-")
        short, name = " ".join(letters), " ".join(parts[x] for x in letters)
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            n = v.replace(".", " ")
            out += [
                _rule(f"cc-{code}-{v}", f"creativecommons org licenses {short} {n}", "creativecommons licenses by", STATEMENT),
                _rule(f"cc-{code}-{v}", f"creative commons {name}(?: {LICENSE})?(?: version)? {n}(?: (?:international|unported|generic))?(?: {LICENSE})?", "creative commons attribution", STATEMENT),
                _rule(f"cc-{code}-{v}", f"(?:licensed under )?cc {short} (?:v ?)?{n}", "cc by", VERSIONED),
            ]
        out += [_rule(f"cc-{code}", f"creative commons {name}(?: {LICENSE})?", "creative commons attribution", NAMED), _rule(f"cc-{code}", f"cc {short}", "cc by", NAMED)]
    out += [_rule("cc0-1.0", "creativecommons org publicdomain zero 1 0", "creativecommons publicdomain zero", STATEMENT), _rule("cc0-1.0", "(?:cc0|cc zero)(?: 1 0)?(?: universal)?", "cc0|zero", VERSIONED), _rule("creative-commons", f"creative commons(?: {LICENSE})?", "creative commons", HINT)]
    # licences with versions
    versioned = (("apache", "apache(?: software)?", "apache", ("1.0", "1.1", "2.0")), ("mpl", "mozilla public", "mozilla public", ("1.0", "1.1", "2.0")), ("epl", "eclipse public", "eclipse public", ("1.0", "2.0")), ("cddl", "common development and distribution", "common development distribution", ("1.0", "1.1")), ("eupl", "european union public", "european union public", ("1.0", "1.1", "1.2")), ("artistic", "artistic", "artistic", ("1.0", "2.0")), ("osl", "open software", "open software", ("1.0", "2.0", "2.1", "3.0")), ("afl", "academic free", "academic free", ("1.1", "1.2", "2.0", "2.1", "3.0")), ("ofl", "(?:sil )?open font", "open font", ("1.0", "1.1")), ("bsl", "boost software", "boost software", ("1.0",)), ("upl", "universal permissive", "universal permissive", ("1.0",)), ("cpl", "common public", "common public", ("1.0",)), ("lppl", "latex project public", "latex public", ("1.0", "1.1", "1.2", "1.3")), ("zpl", "zope public", "zope public", ("1.1", "2.0", "2.1")), ("php", "php", "php", ("3.0", "3.01")), ("ecl", "educational community", "educational community", ("1.0", "2.0")))
    for short, name, keys, versions in versioned:
        for v in versions:
            n = _version(v)
            out += [
                _rule(f"{short}-{v}", f"licensed under the {name} {LICENSE}(?: version)? {n}", f"{keys} {either} licensed", STATEMENT),
                _rule(f"{short}-{v}", f"{name} {LICENSE}(?: version)? {n}", f"{keys} {either}", VERSIONED),
                _rule(f"{short}-{v}", f"{short} {n}", short, VERSIONED),
            ]
        out.append(_rule(short, f"{name} {LICENSE}", f"{keys} {either}", NAMED))
    out.append(_rule("apache-2.0", "apache org licenses license 2 0", "apache licenses", STATEMENT))
    # licences by name and by a sentence of their text
    for label, name, keys in (("mit", "(?:the )?mit", "mit"), ("isc", "isc", "isc"), ("zlib", "zlib", "zlib"), ("x11", "x11", "x11"), ("beerware", "beer ?ware", "beer|beerware"), ("wtfpl", "do what the fuck you want to public", "public"), ("unlicense", "the", "unlicense|unlicence"), ("openssl", "openssl", "openssl"), ("python", "python software foundation", "python"), ("ncsa", "university of illinois ncsa open source", "ncsa")):
        body = "(?:the )?unlicen[cs]e" if label == "unlicense" else f"{name} {LICENSE}"
        out += [_rule(label, body, keys if label == "unlicense" else f"{keys} {either}", NAMED), _rule(label, f"licensed under (?:the )?{body}", f"licensed {keys}", STATEMENT)]
    for n, word in (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        out += [_rule(f"bsd-{n}-clause", f"(?:bsd (?:{n}|{word}) clause|(?:{n}|{word}) clause bsd)(?: {LICENSE})?", "bsd clause", VERSIONED)]
    out += [_rule("bsd", f"bsd(?: style)? {LICENSE}", f"bsd {either}", NAMED)]
    sentences = (
        ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
        ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
        ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
        ("zlib", "this software is provided as is without any express or implied warranty"),
        ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
        ("unlicense", "this is free and unencumbered software released into the public domain"),
        ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
        ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
        ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
        ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
        ("public-domain", "released into the public domain"),
        ("public-domain", "dedicated to the public domain"),
        ("public-domain", "in the public domain"),
        ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
        ("proprietary", "proprietary and confidential"),
        ("proprietary", "may not be reproduced without (?:prior )?(?:written )?permission"),
        ("reserved", "all rights reserved"),
        ("reserved", "tous droits réservés"),
        ("reserved", "alle rechte vorbehalten"),
        ("reserved", "todos los derechos reservados"),
    )
    for label, sentence in sentences:
        words = [w for w in sentence.split() if w.isalpha()]
        keys = sorted(set(words), key=lambda w: (-len(w), w))[:2]
        out.append(_rule(label, sentence, " ".join(keys), HINT if len(words) < 3 else NAMED if len(words) < 6 else STATEMENT))
    for holder in ("copyright(?: c)?", "©"):
        out.append(_rule("copyright", f"{holder} (?:19|20)[0-9]{{2}}(?: (?:19|20)[0-9]{{2}})*", "copyright" if holder[0] == "c" else "©", HINT))
    out.append(_rule("spdx", "spdx license identifier [a-z0-9]+", "spdx identifier", NAMED))
    # further licences and notices, each by its own wording; n is the number of a version
    for label, pattern, keywords, priority in HAND:
        out.append(_rule(label, pattern, keywords, priority))
    return tuple(out)


@cache
def _gates() -> tuple[frozenset[str], dict[str, tuple[int, ...]]]:
    """All words that some rule waits for first, and for each the rules that do."""
    first: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        for w in r.keywords[0]:
            first.setdefault(w, []).append(i)
    return frozenset(first), {w: tuple(v) for w, v in first.items()}


class Found(NamedTuple):
    start: int
    end: int
    rule: int


def detections(joined: str, vocabulary: set[str]) -> list[Found]:
    """Detections that stay, in order of place; joined: the words with a space between, before and behind."""
    names, by = _gates()
    all_rules = rules()
    hits = vocabulary & names
    tried = sorted({i for w in hits for i in by[w] if all(not k.isdisjoint(vocabulary) for k in all_rules[i].keywords)})
    return kept_of([Found(m.start(), m.end(), i) for i in tried for m in all_rules[i].pattern.finditer(joined)])


def kept_of(found: list[Found]) -> list[Found]:
    """Those that no other suppresses, in order of place. One is suppressed if it lies within another of a higher priority, or of
    the same priority that is longer, or as long and listed earlier.

    Lying within is transitive, so it's enough to look at all others, suppressed or not: in order of their starts (longer ones
    first), what lies within an earlier one ends no later than the farthest end so far. For each priority, such farthest ends
    are kept by start and searched, so the time grows like that of sorting.
    """
    all_rules = rules()
    by_priority: dict[int, list[Found]] = {}
    for f in found:
        by_priority.setdefault(all_rules[f.rule].priority, []).append(f)
    out: list[Found] = []
    above: list[tuple[list[int], list[int]]] = []
    for priority in sorted(by_priority, reverse=True):
        starts: list[int] = []
        ends: list[int] = []
        farthest = -1
        for f in sorted(by_priority[priority], key=lambda f: (f.start, -f.end, f.rule)):
            if f.end > farthest:
                farthest = f.end
                starts.append(f.start)
                ends.append(f.end)
                if not any((k := bisect_right(s, f.start)) and e[k - 1] >= f.end for s, e in above):
                    out.append(f)
        above.append((starts, ends))
    return sorted(out)


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, str]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and detections (label:first word:words) of a text."""
    words = WORDS.findall((text or "").encode("utf-8", "replace").lower().decode("utf-8"))  # of bytes, lower() changes A-Z alone
    vocabulary = set(words)
    gated = not vocabulary.isdisjoint(_gates()[0])
    if not gated:
        return len(words), 0, None, None, "", "", 0.0, ""
    joined = f" {' '.join(words)} "
    begins = None

    def word_at(place: int) -> int:
        nonlocal begins
        if begins is None:
            begins, at = [], 1
            for w in words:
                begins.append(at)
                at += len(w) + 1
        return bisect_right(begins, place) - 1

    places, base = [], set()
    for phrase, label in BASE:
        at = joined.find(f" {phrase} ")
        while at >= 0:
            places.append(word_at(at + 1))
            base.add(label)
            at = joined.find(f" {phrase} ", at + 1)
    kept = detections(joined, vocabulary)
    miss = 1.0
    for f in kept:
        miss *= 1 - CONFIDENCE[rules()[f.rule].priority]
    labels = base | {rules()[f.rule].label for f in kept}
    score = round(1 - miss, 6) if kept else 0.5 if base else 0.0
    shown = ",".join(f"{rules()[f.rule].label}:{word_at(f.start)}:{joined.count(' ', f.start, f.end) + 1}" for f in kept)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, shown


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id and what ``scan`` gives for its whole text.

    A null or empty text has no words: counts 0, places null, labels empty strings, score 0. Repeated rows are each scanned;
    other columns are not read. There is no shuffle.
    """
    kinds = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType(), "detections": T.StringType()}
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(*k) for k in kinds.items())])
    arrow = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.string()]

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for part in slices((len(x.as_buffer()) if x.is_valid else 0 for x in texts), 4 << 20):
                columns = zip(*map(scan, texts[part.start : part.stop].to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("id")[part.start : part.stop], *(pa.array(c, t) for c, t in zip(columns, arrow, strict=True))], names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
