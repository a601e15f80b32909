"""Licence scans: ordered signature rules behind a prefilter of literals.

Texts are brought to lower-case words with single spaces. A rule runs only on texts that hold
a literal that each of its matches must hold. Where a detection lies within another one, one of
them is suppressed: a vague one (of no version, or of no known licence) gives way to a definite
one, else the shorter to the longer, else the later rule to the earlier. So "gnu lesser general
public license" is not a plain GPL too, and "MIT-0" not MIT.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants, _parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isospark.llm.common import map_slices, raw_texts

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_LICENCE = r"licen[cs]e"
_VERSION = r"(?: version)?"
#: What may stand before a licence's short name.
_ID = rf"(?:spdx {_LICENCE} identifier |{_LICENCE} )?"
_LATER = r"(?: only| or (?:at your option )?(?:any )?(?:later|newer|above)(?: versions?)?)?"


def _at(number: str) -> str:
    """A version after a name, as words: v3, v 3, version 3, 3.0, -3.0-or-later."""
    digits = number.replace(".", " ")
    return rf"(?: ?v| ver| version)? ?{digits}{'' if ' ' in digits else '(?: 0)?'}{_LATER}"


def _gnu(label: str, name: str, short: str, numbers: tuple[str, ...]) -> tuple:
    """Signatures of a GNU licence: its versions by long and short name, its headers, and what names no version."""
    long = rf"(?:gnu )?{name}(?:gnu )?general public {_LICENCE}"
    brief = rf"{_ID}(?:gnu )?(?:{short}|{name}gpl)" if name else rf"{_ID}(?:gnu )?{short}"
    either = rf"(?:as published by the free software foundation )?(?:either )?version"
    out = []
    for number in numbers:
        digits = number.replace(".", " ")
        ways = (rf"{long}{_at(number)}", rf"{brief}{_at(number)}", rf"version {digits}(?: 0)? of the {long}", rf"{long} {either} {digits}(?: 0)? of the {_LICENCE}{_LATER}")
        out.append((f"{label}-{number}", label, ways))
    return (*out, (label, label, (long, rf"(?:gnu )?{name}gpl" if name else rf"gnu (?:gpl|public {_LICENCE})", rf"under the (?:gnu )?{short}", rf"(?:gnu )?{short}" if name else rf"{short} {_LICENCE}")))


def _bsd(label: str, clauses: str, names: str) -> tuple:
    return (label, "bsd", (rf"{_ID}bsd {clauses} clauses?(?: {_LICENCE})?", rf"(?:{names}|{clauses} clauses?) bsd(?: {_LICENCE})?"))


def _cc(label: str, *parts: str) -> tuple:
    """A Creative Commons licence by its name, its address and its short name."""
    words = {"by": r"(?:attribution|by)", "nc": r" (?:non ?commercial|nc)", "sa": r" (?:share ?alike|sa)", "nd": r" (?:no ?deriv(?:ative|ativ)?e?s?(?: works)?|nd)"}
    kind, number = "".join(words[x] for x in parts), r"(?: v?[1234] [05])?"
    return (label, "creative", (rf"creative commons (?:{_LICENCE} )?{kind}{number}(?: international| unported| generic)?(?: public)?(?: {_LICENCE})?", rf"creativecommons org licenses {' '.join(parts)}{number}", rf"{_ID}cc {' '.join(parts)}{number}"))


#: Fixed values: (label, family, patterns) of the signatures, the more special ones of a family first.
SIGNATURES = (
    *_gnu("agpl", "affero ", "agpl", ("3", "1")),
    *_gnu("lgpl", "(?:lesser|library) ", "lgpl", ("3", "2.1", "2")),
    *_gnu("gpl", "", "gpl", ("3", "2", "1")),
    ("gfdl-1.3", "documentation", (rf"gnu free documentation {_LICENCE}{_VERSION} 1 3", r"gfdl 1 3(?: only| or later)?")),
    ("gfdl-1.2", "documentation", (rf"gnu free documentation {_LICENCE}{_VERSION} 1 2", r"gfdl 1 2(?: only| or later)?")),
    ("gfdl", "documentation", (rf"(?:gnu )?free documentation {_LICENCE}", r"gnu fdl")),
    ("apache-2", "apache", (rf"apache {_LICENCE}{_VERSION} 2(?: 0)?", rf"apache 2(?: 0)?(?: {_LICENCE})?", r"apache org licenses licen[cs]e 2 0")),
    ("apache-1.1", "apache", (rf"apache (?:software )?{_LICENCE}{_VERSION} 1 1", r"apache 1 1")),
    ("apache-1.0", "apache", (rf"apache (?:software )?{_LICENCE}{_VERSION} 1 0", r"apache 1 0")),
    ("apache", "apache", (rf"apache software {_LICENCE}", rf"apache {_LICENCE}")),
    ("mit-0", "mit", (rf"mit no attribution(?: {_LICENCE})?", rf"{_ID}mit 0(?: {_LICENCE})?")),
    ("mit", "mit", (rf"under the (?:terms of the )?mit {_LICENCE}", rf"(?:the )?mit {_LICENCE}", rf"spdx {_LICENCE} identifier mit", r"mit licensed", r"opensource org licenses mit")),
    ("mit", "permission", (r"permission is hereby granted free of charge to any person obtaining a copy of this software",)),
    ("x11", "x11", (rf"(?:mit )?x11 {_LICENCE}", rf"x11 mit {_LICENCE}")),
    ("isc", "isc", (rf"(?:under the )?isc {_LICENCE}", rf"internet systems consortium {_LICENCE}", rf"spdx {_LICENCE} identifier isc")),
    ("isc", "permission", (r"permission to use copy modify and or distribute this software for any purpose with or without fee",)),
    ("bsd-3-clause-clear", "bsd", (rf"{_ID}bsd 3 clause clear(?: {_LICENCE})?", rf"clear bsd {_LICENCE}")),
    _bsd("bsd-4-clause", "(?:4|four)", "original|old"),
    _bsd("bsd-3-clause", "(?:3|three)", "new|revised|modified"),
    _bsd("bsd-2-clause", "(?:2|two)", "simplified|freebsd"),
    ("bsd-2-clause", "bsd", (rf"freebsd {_LICENCE}",)),
    _bsd("bsd-1-clause", "(?:1|one)", "one clause"),
    ("0bsd", "bsd", (r"(?:zero|0) clause bsd", r"bsd zero clause", r"0bsd")),
    ("bsd", "bsd", (rf"bsd (?:style )?{_LICENCE}", r"under the bsd")),
    ("bsd", "redistribution", (r"redistribution and use in source and binary forms with or without modification are permitted",)),
    ("mpl-2", "mozilla", (rf"mozilla public {_LICENCE}{_VERSION} (?:v ?)?2(?: 0)?", r"mozilla org mpl 2 0")),
    ("mpl-1.1", "mozilla", (rf"mozilla public {_LICENCE}{_VERSION} 1 1",)),
    ("mpl-1.0", "mozilla", (rf"mozilla public {_LICENCE}{_VERSION} 1 0",)),
    ("mpl", "mozilla", (rf"mozilla public {_LICENCE}",)),
    ("mpl-2", "mpl", (r"mpl ?2(?: 0)?", r"under the mpl")),
    ("epl-2", "eclipse", (rf"eclipse public {_LICENCE}{_VERSION} (?:v ?)?2(?: 0)?",)),
    ("epl-1", "eclipse", (rf"eclipse public {_LICENCE}{_VERSION} (?:v ?)?1(?: 0)?",)),
    ("epl", "eclipse", (rf"eclipse public {_LICENCE}",)),
    ("edl-1", "eclipse", (rf"eclipse distribution {_LICENCE}(?:{_VERSION} 1(?: 0)?)?",)),
    ("epl-2", "epl", (r"epl 2(?: 0)?",)),
    ("epl-1", "epl", (r"epl 1(?: 0)?",)),
    ("cddl-1.1", "cddl", (r"cddl(?: version)? 1 1",)),
    ("cddl-1.0", "cddl", (r"cddl(?: version)? 1 0", r"under the cddl")),
    ("cddl", "common", (rf"common development and distribution {_LICENCE}",)),
    ("cpl-1", "common", (rf"common public {_LICENCE}(?:{_VERSION} 1 0)?",)),
    ("cpal-1", "common", (rf"common public attribution {_LICENCE}(?:{_VERSION} 1 0)?",)),
    ("ms-pl", "microsoft", (rf"microsoft public {_LICENCE}", r"ms pl")),
    ("ms-rl", "microsoft", (rf"microsoft reciprocal {_LICENCE}", r"ms rl")),
    ("artistic-2", "artistic", (rf"artistic {_LICENCE} 2 0", r"artistic 2 0")),
    ("artistic-1", "artistic", (rf"artistic {_LICENCE} 1 0", r"artistic 1 0")),
    ("artistic", "artistic", (rf"artistic {_LICENCE}", rf"perl artistic {_LICENCE}")),
    ("perl", "perl", (r"same terms as perl(?: itself)?", rf"under the perl {_LICENCE}")),
    ("zlib", "zlib", (rf"zlib(?: libpng)? {_LICENCE}", rf"libpng zlib {_LICENCE}")),
    ("libpng", "libpng", (rf"libpng {_LICENCE}",)),
    ("boost-1", "boost", (rf"boost software {_LICENCE}(?:{_VERSION} 1 0)?", r"bsl 1 0")),
    ("busl-1.1", "business", (rf"business source {_LICENCE}(?:{_VERSION} 1 1)?", r"busl 1 1")),
    ("sspl-1", "server", (rf"server side public {_LICENCE}(?:{_VERSION} 1)?", r"sspl 1 0")),
    ("elastic-2", "elastic", (rf"elastic {_LICENCE}(?: 2 0)?",)),
    ("unlicense", "unlicense", (r"the unlicense", r"unlicense org")),
    ("unlicense", "unencumbered", (r"free and unencumbered software released into the public domain",)),
    ("wtfpl", "wtfpl", (r"wtfpl(?: version 2)?",)),
    ("wtfpl", "want", (rf"do what the fuck you want to public {_LICENCE}",)),
    ("public-domain", "domain", (r"(?:released |dedicated |placed )?(?:in|into|to) the public domain", r"public domain (?:dedication|mark)")),
    ("cc0-1", "cc0", (r"cc0(?: 1 0)?(?: universal)?",)),
    ("cc0-1", "zero", (r"creative commons zero(?: v?1 0)?(?: universal)?",)),
    _cc("cc-by-nc-sa", "by", "nc", "sa"),
    _cc("cc-by-nc-nd", "by", "nc", "nd"),
    _cc("cc-by-nc", "by", "nc"),
    _cc("cc-by-nd", "by", "nd"),
    _cc("cc-by-sa", "by", "sa"),
    _cc("cc-by", "by"),
    ("cc", "creative", (rf"(?:under a )?creative commons {_LICENCE}", r"creative commons")),
    ("ofl-1.1", "font", (rf"(?:sil )?open font {_LICENCE}(?:{_VERSION} 1 1)?", r"ofl 1 1")),
    ("odbl", "database", (rf"open database {_LICENCE}(?: v?1 0)?", rf"open data commons open database {_LICENCE}")),
    ("odc-by", "commons", (rf"open data commons attribution {_LICENCE}",)),
    ("pddl", "commons", (rf"(?:open data commons )?public domain dedication and {_LICENCE}",)),
    ("eupl-1.2", "european", (rf"european union public {_LICENCE}{_at('1.2')}", rf"eupl{_at('1.2')}")),
    ("eupl", "european", (rf"european union public {_LICENCE}",)),
    ("eupl", "eupl", (r"eupl(?: v?1 [012])?",)),
    ("cecill", "cecill", (r"cecill(?: [abc])?(?: [12] [01])?", rf"cecill free software {_LICENCE}")),
    ("osl-3", "open", (rf"open software {_LICENCE}(?:{_VERSION} 3 0)?",)),
    ("afl-3", "academic", (rf"academic free {_LICENCE}(?:{_VERSION} 3 0)?",)),
    ("ecl-2", "educational", (rf"educational community {_LICENCE}(?:{_VERSION} 2 0)?",)),
    ("ncsa", "ncsa", (rf"university of illinois ncsa open source {_LICENCE}", rf"ncsa open source {_LICENCE}")),
    ("python-2", "python", (rf"python software foundation {_LICENCE}(?:{_VERSION} 2)?", rf"psf {_LICENCE}", rf"python {_LICENCE}")),
    ("php-3", "php", (rf"php {_LICENCE}(?:{_VERSION} 3 01?)?",)),
    ("ruby", "ruby", (rf"ruby {_LICENCE}", r"same terms as ruby")),
    ("openssl", "openssl", (rf"openssl (?:ssleay )?{_LICENCE}",)),
    ("postgresql", "postgresql", (rf"postgresql {_LICENCE}",)),
    ("vim", "vim", (rf"vim {_LICENCE}",)),
    ("w3c", "w3c", (rf"w3c software (?:notice and )?{_LICENCE}", rf"w3c {_LICENCE}")),
    ("zpl-2.1", "zope", (rf"zope public {_LICENCE}(?:{_VERSION} 2 1)?",)),
    ("ipa", "ipa", (rf"ipa (?:open )?font {_LICENCE}",)),
    ("latex-1.3", "latex", (rf"latex project public {_LICENCE}(?:{_VERSION} 1 3c?)?",)),
    ("latex-1.3", "lppl", (r"lppl(?: v?1 3c?)?",)),
    ("qpl-1", "q", (rf"q public {_LICENCE}(?:{_VERSION} 1 0)?",)),
    ("sleepycat", "sleepycat", (rf"sleepycat {_LICENCE}",)),
    ("upl-1", "universal", (rf"universal permissive {_LICENCE}(?:{_VERSION} 1 0)?",)),
    ("mulan-2", "mulan", (rf"mulan (?:psl|permissive software {_LICENCE})(?: v?2)?",)),
    ("hippocratic", "hippocratic", (rf"hippocratic {_LICENCE}",)),
    ("openrail-m", "openrail", (r"(?:bigscience |creativeml )?openrail ?m?",)),
    ("rail", "responsible", (rf"responsible ai {_LICENCE}",)),
    ("llama-community", "llama", (rf"llama [23](?: [123])? community {_LICENCE}",)),
    ("proprietary", "rights", (r"all rights reserved",)),
    ("proprietary", "proprietary", (rf"proprietary (?:and confidential|{_LICENCE}|software)",)),
    ("commercial", "commercial", (rf"commercial {_LICENCE}", r"not for commercial use", r"non commercial use only")),
    ("eula", "user", (rf"end user {_LICENCE} agreement",)),
    ("copyright", "copyright", (r"copyright (?:c )?(?:19|20)[0-9][0-9]", r"copyright notice")),
    ("copyright", "copyrighted", (r"copyrighted material",)),
    ("apache-2", "spdx", (rf"spdx {_LICENCE} identifier apache 2 0",)),
    ("unknown", "licensed", (r"licensed under", r"licen[cs]ed to")),
    ("unknown", "license", (r"(?:see|read) the licen[cs]e", r"license agreement", r"released under the [a-z0-9]{1,40} licen[cs]e")),
    ("epl-2", "url", (r"eclipse org legal epl 2 0", r"eclipse org legal epl v20")),
    ("epl-1", "url", (r"eclipse org legal epl v10",)),
    ("gpl-3", "url", (r"gnu org licenses gpl 3 0", r"opensource org licenses gpl 3 0", r"spdx org licenses gpl 3 0")),
    ("gpl-2", "url", (r"gnu org licenses (?:old licenses )?gpl 2 0", r"opensource org licenses gpl 2 0", r"spdx org licenses gpl 2 0")),
    ("lgpl-3", "url", (r"gnu org licenses lgpl 3 0", r"opensource org licenses lgpl 3 0")),
    ("lgpl-2.1", "url", (r"gnu org licenses (?:old licenses )?lgpl 2 1", r"opensource org licenses lgpl 2 1")),
    ("agpl-3", "url", (r"gnu org licenses agpl(?: 3 0)?", r"opensource org licenses agpl 3 0")),
    ("gfdl", "url", (r"gnu org (?:copyleft|licenses) fdl",)),
    ("apache-2", "url", (r"apache org licenses license 2 0(?: txt| html)?", r"opensource org licenses apache 2 0", r"spdx org licenses apache 2 0")),
    ("mit", "url", (r"opensource org license mit", r"spdx org licenses mit", r"choosealicense com licenses mit")),
    ("isc", "url", (r"opensource org licenses isc", r"spdx org licenses isc")),
    ("bsd-3-clause", "url", (r"opensource org licenses bsd 3 clause", r"spdx org licenses bsd 3 clause")),
    ("bsd-2-clause", "url", (r"opensource org licenses bsd 2 clause", r"spdx org licenses bsd 2 clause")),
    ("mpl-2", "url", (r"mozilla org (?:en us )?mpl 2 0", r"opensource org licenses mpl 2 0")),
    ("cc0-1", "url", (r"creativecommons org publicdomain zero 1 0",)),
    ("public-domain", "url", (r"creativecommons org publicdomain mark 1 0",)),
    ("unlicense", "url", (r"opensource org licenses unlicense", r"unlicense org unlicense")),
    ("zlib", "url", (r"opensource org licenses zlib", r"zlib net zlib license")),
    ("boost-1", "url", (r"boost org license 1 0(?: txt)?", r"opensource org licenses bsl 1 0")),
    ("wtfpl", "url", (r"wtfpl net",)),
    ("artistic-2", "url", (r"opensource org licenses artistic 2 0", r"perlfoundation org artistic license 2 0")),
    ("ofl-1.1", "url", (r"scripts sil org ofl", r"opensource org licenses ofl 1 1", r"openfontlicense org")),
    ("odbl", "url", (r"opendatacommons org licenses odbl",)),
    ("odc-by", "url", (r"opendatacommons org licenses by",)),
    ("pddl", "url", (r"opendatacommons org licenses pddl",)),
    ("eupl-1.2", "url", (r"eupl eu 1 2", r"opensource org licenses eupl 1 2")),
    ("cecill", "url", (r"cecill info licences",)),
    ("cddl-1.0", "url", (r"opensource org licenses cddl 1 0",)),
    ("afl-3", "url", (r"opensource org licenses afl 3 0",)),
    ("osl-3", "url", (r"opensource org licenses osl 3 0",)),
    ("ncsa", "url", (r"opensource org licenses ncsa",)),
    ("postgresql", "url", (r"opensource org licenses postgresql",)),
    ("upl-1", "url", (r"opensource org licenses upl",)),
    ("elastic-2", "url", (rf"elastic co licensing elastic {_LICENCE}",)),
    ("sspl-1", "url", (rf"mongodb com licensing server side public {_LICENCE}",)),
    ("0bsd", "spdx", (rf"spdx {_LICENCE} identifier 0bsd",)),
    ("mpl-2", "spdx", (rf"spdx {_LICENCE} identifier mpl 2 0",)),
    ("epl-2", "spdx", (rf"spdx {_LICENCE} identifier epl 2 0",)),
    ("cc0-1", "spdx", (rf"spdx {_LICENCE} identifier cc0 1 0",)),
    ("unlicense", "spdx", (rf"spdx {_LICENCE} identifier unlicense",)),
    ("zlib", "spdx", (rf"spdx {_LICENCE} identifier zlib",)),
    ("boost-1", "spdx", (rf"spdx {_LICENCE} identifier bsl 1 0",)),
    ("artistic-2", "spdx", (rf"spdx {_LICENCE} identifier artistic 2 0",)),
    ("ofl-1.1", "spdx", (rf"spdx {_LICENCE} identifier ofl 1 1",)),
    ("wtfpl", "spdx", (rf"spdx {_LICENCE} identifier wtfpl",)),
    ("mit", "text", (r"the above copyright notice and this permission notice shall be included in all copies", r"mit style", r"expat licen[cs]e")),
    ("mit", "badge", (r"licen[cs]e mit", r"licen[cs]ed? under (?:the )?mit")),
    ("apache-2", "text", (r"you may not use this file except in compliance with the licen[cs]e", r"asl ?2(?: 0)?", r"licen[cs]ed under (?:the )?apache 2(?: 0)?")),
    ("bsd", "text", (r"neither the name of the copyright holder nor the names of its contributors", r"licen[cs]ed under (?:the )?bsd")),
    ("bsd-4-clause", "text", (r"all advertising materials mentioning features or use of this software",)),
    ("zlib", "text", (r"this software is provided as is without any express or implied warranty in no event",)),
    ("boost-1", "text", (r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software",)),
    ("gpl", "text", (r"this program is free software you can redistribute it and or modify", r"copyleft gpl", r"licen[cs]ed under (?:the )?(?:gnu )?gpl")),
    ("gpl", "text", (r"this program is distributed in the hope that it will be useful but without any warranty",)),
    ("lgpl", "text", (r"this library is free software you can redistribute it and or modify",)),
    ("mpl-2", "text", (r"this source code form is subject to the terms of the mozilla public licen[cs]e",)),
    ("epl", "text", (r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e",)),
    ("wtfpl", "text", (r"you just do what the fuck you want to",)),
    ("unlicense", "text", (r"anyone is free to copy modify publish use compile sell or distribute this software",)),
    ("beerware", "text", (r"beer ?ware(?: licen[cs]e)?", r"buy me a beer in return")),
    ("json", "text", (r"the software shall be used for good not evil", r"json licen[cs]e")),
    ("curl", "curl", (rf"curl {_LICENCE}",)),
    ("tcl", "tcl", (rf"tcl tk {_LICENCE}", rf"tcl {_LICENCE}")),
    ("ntp", "ntp", (rf"ntp {_LICENCE}",)),
    ("naist", "naist", (rf"naist {_LICENCE}",)),
    ("unicode", "unicode", (rf"unicode {_LICENCE} agreement", rf"unicode {_LICENCE}", r"unicode data files and software")),
    ("icu", "icu", (rf"icu {_LICENCE}",)),
    ("ijg", "ijg", (rf"independent jpeg group s? ?{_LICENCE}", rf"ijg {_LICENCE}")),
    ("freetype", "freetype", (rf"freetype (?:project )?{_LICENCE}", rf"ftl {_LICENCE}")),
    ("imagemagick", "imagemagick", (rf"imagemagick {_LICENCE}",)),
    ("blueoak-1", "blue", (rf"blue oak model {_LICENCE}(?: 1 0 0)?",)),
    ("parity-7", "parity", (rf"parity public {_LICENCE}(?: 7 0 0)?",)),
    ("polyform", "polyform", (rf"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) {_LICENCE}(?: 1 0 0)?",)),
    ("commons-clause", "clause", (r"commons clause",)),
    ("fair-source", "fair", (rf"fair source {_LICENCE}", rf"functional source {_LICENCE}")),
    ("confluent", "confluent", (rf"confluent community {_LICENCE}",)),
    ("redis-source", "redis", (rf"redis source available {_LICENCE}", r"rsalv2")),
    ("timescale", "timescale", (rf"timescale {_LICENCE}",)),
    ("rpl-1.5", "reciprocal", (rf"reciprocal public {_LICENCE}(?: 1 5)?",)),
    ("apsl-2", "apsl", (rf"apple public source {_LICENCE}(?: 2 0)?", r"apsl 2 0")),
    ("ibmpl-1", "ibm", (rf"ibm public {_LICENCE}(?: 1 0)?",)),
    ("nposl-3", "nonprofit", (rf"non profit open software {_LICENCE}(?: 3 0)?",)),
    ("sun-public", "sun", (rf"sun public {_LICENCE}(?: 1 0)?", rf"sun industry standards source {_LICENCE}")),
    ("nasa-1.3", "nasa", (rf"nasa open source agreement(?: 1 3)?",)),
    ("ogl-uk", "government", (rf"open government {_LICENCE}(?: v?[123] 0)?",)),
    ("etalab", "etalab", (r"licence ouverte(?: etalab)?(?: 2 0)?", r"etalab open licen[cs]e")),
    ("dl-de-by", "datenlizenz", (r"datenlizenz deutschland(?: namensnennung)?(?: 2 0)?",)),
    ("cdla", "cdla", (r"community data licen[cs]e agreement(?: permissive| sharing)?(?: [12] 0)?", r"cdla (?:permissive|sharing)(?: [12] 0)?")),
    ("c-uda", "data", (r"computational use of data agreement",)),
    ("gemma", "gemma", (r"gemma terms of use",)),
    ("deepseek", "deepseek", (rf"deepseek {_LICENCE}",)),
    ("falcon", "falcon", (rf"falcon (?:180b )?(?:tii )?{_LICENCE}",)),
    ("bigcode-openrail-m", "openrail", (r"bigcode openrail m",)),
    ("free-art", "art", (rf"free art {_LICENCE}(?: 1 3)?", r"licence art libre(?: 1 3)?")),
    ("gust-font", "gust", (rf"gust font {_LICENCE}",)),
    ("ubuntu-font", "ubuntu", (rf"ubuntu font {_LICENCE}(?: 1 0)?",)),
    ("bitstream-vera", "vera", (rf"bitstream vera (?:fonts? )?{_LICENCE}",)),
    ("dual", "dual", (r"dual licen[cs]ed?", r"licen[cs]ed under either of")),
    ("proprietary", "rights", (r"no part of this (?:publication|book|document) may be reproduced", r"unauthori[sz]ed (?:copying|reproduction|distribution)", r"trade secrets? of")),
    ("non-commercial", "noncommercial", (r"for non ?commercial (?:use|purposes)(?: only)?", r"personal use only", r"for personal and non ?commercial use")),
    ("research-only", "research", (r"for (?:academic|research) (?:use|purposes) only", r"research only licen[cs]e")),
    ("evaluation", "evaluation", (r"for evaluation (?:use|purposes) only", r"evaluation licen[cs]e")),
    ("freeware", "freeware", (r"this (?:program|software) is freeware", r"freeware licen[cs]e")),
    ("shareware", "shareware", (r"this (?:program|software) is shareware", r"shareware licen[cs]e")),
    ("eula", "user", (r"end user licen[cs]e", r"software licen[cs]e agreement")),
    ("unknown", "licence", (r"some rights reserved", r"open source licen[cs]e", r"permissive licen[cs]e", r"free software licen[cs]e", r"under the same licen[cs]e", r"copyleft licen[cs]e", r"licen[cs]e terms", r"terms of the licen[cs]e")),
)
VAGUE = {"unknown", "copyright", "cc", "gpl", "lgpl", "agpl", "apache", "bsd", "mpl", "epl"}


def literals(pattern: str) -> tuple[str, ...]:
    """Literals of which each match of `pattern`, with the spaces around it, holds one at least: the longest run, or one of each alternative."""

    def needed(tree) -> tuple[str, ...]:
        found, run = [], ""
        for kind, value in [*tree, (None, None)]:
            if kind is _constants.LITERAL:
                run += chr(value)
                continue
            found.append((run,))
            run = ""
            if kind is _constants.SUBPATTERN:
                found.append(needed(value[-1]))
            elif kind is _constants.MAX_REPEAT and value[0] > 0:
                found.append(needed(value[2]))
            elif kind is _constants.BRANCH:
                found.append(tuple(x for way in value[1] for x in needed(way)))
        return max(found, key=lambda ways: min(map(len, ways)))

    return needed(_parser.parse(f" {pattern} "))


@dataclass(frozen=True)
class Rule:
    label: str
    gates: tuple[str, ...]
    pattern: re.Pattern
    priority: int


#: One rule for each pattern; the first has the highest priority.
RULES = [Rule(label, literals(p), re.compile(f"(?<= )(?:{p})(?= )"), -n) for n, (label, p) in enumerate(dict.fromkeys((label, p) for label, _, ps in SIGNATURES for p in ps))]

#: More characters than any pattern can match: patterns repeat single characters and short parts only, with a bound.
REACH = 512
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


class Scanner:
    """Finds base phrases and signatures in one text at a time."""

    def __init__(self, rules: list[Rule] = RULES, base=BASE):
        self.base = [(f" {phrase} ".encode(), label) for phrase, label in base]
        self.gates = ahocorasick.Automaton()
        by_gate: dict[str, list[Rule]] = {}
        for rule in rules:
            for gate in rule.gates:
                by_gate.setdefault(gate, []).append(rule)
        for gate, gated in by_gate.items():
            self.gates.add_word(gate, gated)
        self.gates.make_automaton()

    def detections(self, text: str) -> list[tuple[int, int, Rule]]:
        """(begin, end, rule) of what is left after suppression, of lower-case words with a space on each side."""
        gated = {id(rules): rules for _, rules in self.gates.iter(text)}
        open_ = {r.priority: r for rules in gated.values() for r in rules}
        found = [(m.start(), m.end(), r) for r in open_.values() for m in r.pattern.finditer(text)]
        found.sort(key=lambda d: (d[2].label in VAGUE, d[0] - d[1], -d[2].priority, d[0]))
        near: dict[int, list[tuple[int, int, Rule]]] = defaultdict(list)  # by begin // REACH; no detection is longer than REACH
        for begin, end, rule in found:
            cell, vague = begin // REACH, rule.label in VAGUE
            around = [k for c in (cell - 1, cell, cell + 1) for k in near[c]]
            if any(b <= begin and end <= e or vague and r.label not in VAGUE and begin <= b and e <= end for b, e, r in around):
                continue
            near[cell].append((begin, end, rule))
        return sorted((d for ds in near.values() for d in ds), key=lambda d: d[:2])

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
        """(number of words, base places (first word, label), detections (first word, last word, label))."""
        words = data.translate(_TO_WORDS).split()
        text = b" " + b" ".join(words) + b" "
        places = []
        for phrase, label in self.base:
            at = text.find(phrase)
            while at >= 0:
                places.append((at, label))
                at = text.find(phrase, at + 1)
        marks = self.detections(text.decode("latin-1"))  # one character for each byte
        if not places and not marks:
            return len(words), [], []
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
        word = lambda at: int(np.searchsorted(spaces, at))  # noqa: E731  the word after the space at `at`
        return len(words), [(word(at), k) for at, k in places], [(word(b) - 1, word(e) - 1, r.label) for b, e, r in marks]


def score(base: int, marks: list[str]) -> float:
    """How surely a text names a licence: 1 with a base phrase, 0.9 with a definite signature, 0.5 with a vague one, 0 with none."""
    return 1.0 if base else 0.9 if set(marks) - VAGUE else 0.5 if marks else 0.0


_scanners: list[Scanner] = []


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, base array<struct<word, label>>, marks array<struct<first, last, label>>, score) of each row of `docs`.

    Words are counted from 0. Null and empty texts have no words and score 0. Repeated rows and
    null ids stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanners:
            _scanners.append(Scanner())
        base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        mark_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string())]))
        for batch in batches:
            found = [_scanners[0].scan(t) for t in raw_texts(batch.column(1))]
            n = pa.array(np.array([f[0] for f in found], np.int64))
            base = pa.array([[{"word": w, "label": k} for w, k in f[1]] for f in found], base_type)
            marks = pa.array([[{"first": a, "last": b, "label": k} for a, b, k in f[2]] for f in found], mark_type)
            sure = pa.array([score(len(f[1]), [m[2] for m in f[2]]) for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, base, marks, sure], names=["id", "n_words", "base", "marks", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, base array<struct<word:long,label:string>>, marks array<struct<first:long,last:long,label:string>>, score double"
    return map_slices(rows, run, schema).withColumnRenamed("id", id_col)


def license_labels(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): the scan in one row for each row of `docs`.

    Null and empty texts have no words, places and labels, and score 0; first_word and last_word
    are null without a place. Repeated rows and null ids stay as they are; an empty table gives
    an empty one; texts of any length are read whole; other columns are not read.
    """
    base, marks = F.col("base.label"), F.col("marks.label")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return license_scan(docs).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, marks)).alias("labels"),
        "score",
    )
