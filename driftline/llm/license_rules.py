"""Signatures of licenses over normalised text: words in lower case, one space between them.

A rule is ``(label, confidence, keywords, pattern)``.  A pattern is tried only on texts that
hold one of its keywords.  Rules stand in order of priority: full texts, grants and notices
before titles, a title with a version before one without, identifiers before loose names.
Families that differ by a version or a clause only are written once and spelled out here.
"""

from __future__ import annotations

Rule = tuple[str, float, tuple[str, ...], str]

GNU = {"gpl": r"general", "lgpl": r"(?:lesser|library) general", "agpl": r"affero general"}
NUMBERS = {
    "gpl": ("1", "2", "3"), "lgpl": ("2", "2.1", "3"), "agpl": ("1", "3"), "apache": ("1", "1.1", "2"), "mpl": ("1", "1.1", "2"), "epl": ("1", "2"),
    "cddl": ("1", "1.1"), "cc": ("1", "2", "2.5", "3", "4"), "gfdl": ("1.1", "1.2", "1.3"), "osl": ("1", "2", "2.1", "3"), "afl": ("1.1", "1.2", "2", "2.1", "3"),
    "eupl": ("1", "1.1", "1.2"), "artistic": ("1", "2"), "lppl": ("1", "1.1", "1.2", "1.3"), "ofl": ("1", "1.1"), "zpl": ("1.1", "2", "2.1"), "cecill": ("1", "1.1", "2", "2.1"),
    "php": ("3", "3.01"), "bsl": ("1",), "cpl": ("1",),
}


def _v(version: str) -> str:
    """A version among words: ``2``, ``2 0``, ``v2``, ``version 2 0``."""
    head, _, tail = version.partition(".")
    return rf"v?{head} {tail}" if tail else rf"v?{head}(?: 0)?"


def _name(version: str) -> str:
    return version if "." in version else f"{version}.0"


VERSION = r"(?:version |ver |v )?"
LATER = r"(?: of the license)?(?: or (?:at your option )?(?:any later|later|newer)| plus)"


def _texts() -> list[Rule]:
    """Sentences of full license texts and notices."""
    redistribution = r"redistribution and use in source and binary forms with or without modification are permitted"
    grant = r"permission is hereby granted free of charge to any person obtaining a copy of this software"
    use = r"permission to use copy modify and (?:or )?distribute this software (?:and its documentation )?for any purpose"
    return [
        ("mit-0", 1.0, ("permission is hereby",), grant + r"(?: [^ ]+){0,40}? to permit persons to whom the software is furnished to do so the software is provided"),
        ("x11-distribute-modifications", 1.0, ("permission is hereby",), grant + r"(?: [^ ]+){0,90}? distribute with modifications"),
        ("x11", 1.0, ("permission is hereby",), grant + r"(?: [^ ]+){0,200}? except as contained in this notice"),
        ("mit", 1.0, ("permission is hereby",), grant + r"(?: and associated documentation files)?"),
        ("bsl-1.0", 1.0, ("permission is hereby",), r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
        ("icu", 1.0, ("permission is hereby",), r"permission is hereby granted free of charge to any person obtaining a copy of (?:the unicode data files|the data files)"),
        ("bsd-4-clause", 1.0, ("redistribution and use",), redistribution + r"(?: [^ ]+){0,90}? all advertising materials mentioning features"),
        ("bsd-3-clause-clear", 1.0, ("redistribution and use",), redistribution + r"(?: [^ ]+){0,140}? no express or implied licenses to any party s patent rights"),
        ("bsd-3-clause", 1.0, ("redistribution and use",), redistribution + r"(?: [^ ]+){0,90}? (?:neither the name|the names? of)(?: [^ ]+){1,30}? endorse or promote"),
        ("apache-1.1", 1.0, ("redistribution and use",), redistribution + r"(?: [^ ]+){0,90}? this product includes software developed by the apache"),
        ("bsd-2-clause", 1.0, ("redistribution and use",), redistribution),
        ("bsd-1-clause", 0.9, ("redistribution and use",), r"redistribution and use in source form with or without modification (?:is|are) permitted"),
        ("0bsd", 1.0, ("permission to use",), use + r" with or without fee is hereby granted the software is provided"),
        ("isc", 1.0, ("permission to use",), use + r" with or without fee is hereby granted provided"),
        ("hpnd", 0.9, ("permission to use",), use + r" and without fee is hereby granted"),
        ("ntp", 0.9, ("permission to use",), use + r" with or without fee is hereby granted"),
        ("zlib", 1.0, ("as is without any",), r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
        ("unlicense", 1.0, ("public domain",), r"this is free and unencumbered software released into the public domain"),
        ("wtfpl", 1.0, ("what the fuck",), r"do what the fuck you want to(?: public license)?"),
        ("beerware", 1.0, ("beer",), r"(?:you can buy me a beer in return|the beer ware license|beerware license)"),
        ("json", 1.0, ("good not evil",), r"shall be used for good not evil"),
        ("apache-2.0", 1.0, ("apache",), r"licensed under the apache license version 2(?: 0)?(?: the license)?(?: you may not use this file except in compliance)?"),
        ("apache-2.0", 1.0, ("each contributor",), r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
        ("mpl-2.0", 1.0, ("mozilla",), r"this source code form is subject to the terms of the mozilla public license v 2 0"),
        ("mpl-1.1", 1.0, ("mozilla",), r"contents of this file are subject to the mozilla public license version 1 1"),
        ("epl-2.0", 1.0, ("eclipse",), r"under the terms of the eclipse public license v ?2 0"),
        ("epl-1.0", 1.0, ("eclipse",), r"under the terms of the eclipse public license v ?1 0"),
        ("ms-pl", 1.0, ("this license governs",), r"this license governs use of the accompanying software if you use the software you accept this license"),
        ("ofl-1.1", 1.0, ("sil open",), r"licensed under the sil open font license version 1 1"),
        ("cc0-1.0", 1.0, ("waive",), r"to the extent possible under law(?: [^ ]+){1,30}? waived all copyright and related or neighboring rights"),
        ("cc0-1.0", 1.0, ("public domain",), r"dedicated to the public domain under cc0"),
        ("public-domain", 0.9, ("public domain",), r"(?:has been |is )?(?:released|placed|dedicated|put) (?:in|into|to) the public domain"),
        ("public-domain", 0.7, ("public domain",), r"this (?:work|file|code|software|document|text|data) is in the public domain"),
        ("curl", 0.9, ("permission to use",), r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided(?: [^ ]+){0,60}? curl"),
        ("python-2.0", 1.0, ("python software",), r"python software foundation license(?: version 2| agreement)?"),
        ("postgresql", 1.0, ("postgresql",), r"postgresql licen[cs]e"),
        ("unicode", 0.9, ("unicode",), r"unicode (?:inc )?license agreement"),
        ("proprietary", 0.6, ("prohibited",), r"(?:unauthorized|unauthorised) (?:copying|reproduction|use|distribution)(?: [^ ]+){0,20}? (?:strictly )?prohibited"),
    ]


def _gnu() -> list[Rule]:
    out: list[Rule] = []
    for kind, words in GNU.items():
        title = rf"(?:gnu )?{words} public licen[cs]e"
        ids = rf"(?:gnu )?{kind}"
        for n in NUMBERS[kind]:
            v, label = _v(n), f"{kind}-{_name(n)}"
            keys = (kind, "public licen")
            notice = rf"{title}(?: gnu)?(?: {kind})?(?: as published by the free software foundation)?(?: either)? {VERSION}{v}"
            out += [
                (f"{label}-or-later", 1.0, keys, notice + LATER),
                (f"{label}-only", 1.0, keys, notice + r"(?: of the license)? only"),
                (label, 1.0, keys, notice),
                (f"{label}-or-later", 1.0, keys, rf"{VERSION}{v}{LATER}(?: [^ ]+){{0,6}}? {title}"),
                (label, 0.95, keys, rf"{VERSION}{v} of the {title}"),
                (f"{label}-or-later", 0.95, (kind,), rf"{ids} ?{VERSION}{v}{LATER}(?: version)?"),
                (f"{label}-only", 0.95, (kind,), rf"{ids} ?{VERSION}{v} only"),
                (label, 0.95, (kind,), rf"{ids} ?{VERSION}{v}"),
            ]
    for kind, words in (("agpl", GNU["agpl"]), ("lgpl", GNU["lgpl"])):
        out += [
            (kind, 0.9, ("public licen",), rf"(?:gnu )?{words} public licen[cs]e"),
            (kind, 0.7, (kind,), rf"(?:gnu {kind}|{kind} licen[cs]ed?|licen[cs]ed under the {kind}|under {kind})"),
        ]
    out += [
        ("gpl", 0.9, ("public licen",), r"gnu general public licen[cs]e"),
        ("gpl", 0.9, ("public licen",), r"gnu public licen[cs]e"),
        ("gpl", 0.7, ("public licen",), r"general public licen[cs]e"),
        ("gpl", 0.7, ("gpl",), r"(?:gnu gpl|gpl licen[cs]ed?|licen[cs]ed under the gpl|under the gpl)"),
    ]
    for n in NUMBERS["gfdl"]:
        out += [
            (f"gfdl-{n}-or-later", 1.0, ("documentation",), rf"(?:gnu )?free documentation licen[cs]e {VERSION}{_v(n)}{LATER}"),
            (f"gfdl-{n}", 1.0, ("documentation",), rf"(?:gnu )?free documentation licen[cs]e {VERSION}{_v(n)}"),
            (f"gfdl-{n}", 0.95, ("fdl",), rf"g?fdl {VERSION}{_v(n)}"),
        ]
    out.append(("gfdl", 0.9, ("documentation",), r"(?:gnu )?free documentation licen[cs]e"))
    return out


def _creative_commons() -> list[Rule]:
    clauses = {
        "by-nc-sa": (r"by nc sa", r"attribution non ?commercial share ?alike"),
        "by-nc-nd": (r"by nc nd", r"attribution non ?commercial no ?deriv(?:ative)?(?:s|es)?(?: works)?"),
        "by-nc": (r"by nc", r"attribution non ?commercial"),
        "by-nd": (r"by nd", r"attribution no ?deriv(?:ative)?(?:s|es)?(?: works)?"),
        "by-sa": (r"by sa", r"attribution share ?alike"),
        "by": (r"by", r"attribution"),
    }
    out: list[Rule] = []
    for clause, (short, words) in clauses.items():
        for n in NUMBERS["cc"]:
            v, label = _v(n), f"cc-{clause}-{_name(n)}"
            out += [
                (label, 1.0, ("cc by",), rf"cc {short} {VERSION}{v}"),
                (label, 1.0, ("creative commons",), rf"creative commons {words} {VERSION}{v}(?: (?:international|unported|generic))?"),
                (label, 0.9, ("attribution",), rf"{words} {VERSION}{v} (?:international|unported|generic)"),
                (label, 1.0, ("creativecommons",), rf"creativecommons org licenses {short} {v}"),
            ]
        out += [
            (f"cc-{clause}", 0.9, ("creativecommons",), rf"creativecommons org licenses {short}"),
            (f"cc-{clause}", 0.9, ("creative commons",), rf"creative commons {words}"),
            (f"cc-{clause}", 0.8, ("cc by",), rf"cc {short}"),
        ]
    out += [
        ("cc0-1.0", 1.0, ("cc0",), r"cc0(?: v?1 0)?(?: universal)?(?: public domain dedication)?"),
        ("cc0-1.0", 1.0, ("creativecommons",), r"creativecommons org publicdomain zero"),
        ("cc-pdm-1.0", 1.0, ("creativecommons",), r"creativecommons org publicdomain mark"),
        ("cc", 0.6, ("creative commons",), r"creative commons licen[cs]e"),
    ]
    return out


def _titles() -> list[Rule]:
    """Titles with a version, then without one, then the identifiers."""
    families = {
        "apache": (r"apache (?:software )?licen[cs]e", ("apache",), r"apache"),
        "mpl": (r"mozilla public licen[cs]e(?: mpl)?", ("mozilla", "mpl"), r"mpl"),
        "epl": (r"eclipse public licen[cs]e(?: epl)?", ("eclipse", "epl"), r"epl"),
        "cddl": (r"common development and distribution licen[cs]e(?: cddl)?", ("common development", "cddl"), r"cddl"),
        "cpl": (r"common public licen[cs]e(?: cpl)?", ("common public",), None),
        "osl": (r"open software licen[cs]e(?: osl)?", ("open software",), None),
        "afl": (r"academic free licen[cs]e(?: afl)?", ("academic free",), None),
        "eupl": (r"european union public licen[cs]e(?: eupl)?", ("european union", "eupl"), r"eupl"),
        "artistic": (r"artistic licen[cs]e", ("artistic",), r"artistic"),
        "lppl": (r"latex project public licen[cs]e(?: lppl)?", ("latex project", "lppl"), r"lppl"),
        "ofl": (r"(?:sil )?open font licen[cs]e(?: ofl)?", ("open font",), None),
        "zpl": (r"zope public licen[cs]e(?: zpl)?", ("zope", "zpl"), r"zpl"),
        "cecill": (r"cecill(?: [bc])? (?:free software )?licen[cs]e(?: agreement)?", ("cecill",), r"cecill"),
        "php": (r"php licen[cs]e", ("php licen",), None),
        "bsl": (r"boost software licen[cs]e", ("boost",), None),
    }
    out: list[Rule] = []
    for kind, (title, keys, short) in families.items():
        for n in NUMBERS[kind]:
            out.append((f"{kind}-{_name(n)}", 1.0, keys, rf"{title} {VERSION}{_v(n)}"))
            if short:
                out.append((f"{kind}-{_name(n)}", 0.95, keys, rf"{short} {VERSION}{_v(n)}"))
        out.append((kind, 0.9, keys, title))
    for n, number in (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        label = f"bsd-{n}-clause"
        out += [
            (label, 1.0, ("bsd",), rf"bsd (?:{n}|{number}) clause(?: licen[cs]e)?"),
            (label, 1.0, ("bsd",), rf"(?:{n}|{number}) clause bsd(?: licen[cs]e)?"),
        ]
    out += [
        ("bsd-3-clause", 0.95, ("bsd",), r"(?:new|modified|revised) bsd licen[cs]e"),
        ("bsd-2-clause", 0.95, ("bsd",), r"(?:simplified|freebsd) bsd licen[cs]e"),
        ("bsd-4-clause", 0.95, ("bsd",), r"(?:original|old) bsd licen[cs]e"),
        ("bsd", 0.9, ("bsd",), r"bsd (?:style )?licen[cs]e"),
        ("bsd", 0.7, ("bsd",), r"licen[cs]ed under (?:the )?bsd"),
        ("mit", 0.95, ("mit lic",), r"(?:the )?mit licen[cs]e(?: mit)?"),
        ("mit", 0.9, ("x11 lic", "expat"), r"(?:x11|expat) licen[cs]e"),
        ("mit", 0.8, ("licensed under",), r"licensed under mit"),
        ("mit-0", 1.0, ("mit no", "mit 0"), r"(?:mit no attribution|spdx license identifier mit 0)"),
        ("isc", 0.95, ("isc lic",), r"isc licen[cs]e"),
        ("zlib", 0.95, ("zlib",), r"zlib (?:libpng )?licen[cs]e"),
        ("libpng", 0.95, ("libpng",), r"libpng licen[cs]e"),
        ("openssl", 0.95, ("openssl",), r"openssl licen[cs]e"),
        ("ssleay", 0.95, ("ssleay",), r"(?:original )?ssleay licen[cs]e"),
        ("unlicense", 0.95, ("unlicense",), r"(?:the unlicense|unlicense org)"),
        ("ms-pl", 0.95, ("microsoft",), r"microsoft public licen[cs]e(?: ms pl)?"),
        ("ms-rl", 0.95, ("microsoft",), r"microsoft reciprocal licen[cs]e(?: ms rl)?"),
        ("ncsa", 0.95, ("illinois",), r"university of illinois ncsa open source licen[cs]e"),
        ("w3c", 0.95, ("w3c",), r"w3c (?:software )?(?:notice and )?licen[cs]e"),
        ("vim", 0.9, ("vim lic",), r"vim licen[cs]e"),
        ("ruby", 0.9, ("ruby",), r"(?:under the same terms as ruby|ruby licen[cs]e)"),
        ("perl", 0.9, ("perl",), r"(?:under )?the same terms as perl(?: itself)?"),
        ("qpl-1.0", 0.95, ("q public",), r"q public licen[cs]e"),
        ("ipl-1.0", 0.95, ("ibm public",), r"ibm public licen[cs]e"),
        ("bsl-1.1", 0.95, ("business source",), r"business source licen[cs]e(?: 1 1)?"),
        ("sspl-1.0", 0.95, ("server side",), r"server side public licen[cs]e"),
        ("elastic-2.0", 0.95, ("elastic licen",), r"elastic licen[cs]e(?: 2 0)?"),
        ("odbl-1.0", 0.95, ("open database", "odbl"), r"(?:open database licen[cs]e|odbl)(?: v?1 0)?"),
        ("odc-by-1.0", 0.95, ("open data commons",), r"open data commons attribution licen[cs]e"),
        ("pddl-1.0", 0.95, ("open data commons",), r"open data commons public domain dedication"),
        ("ogl-3.0", 0.95, ("open government",), r"open government licen[cs]e(?: v?3 0)?"),
        ("mulan-psl-2.0", 0.95, ("mulan",), r"mulan (?:permissive software licen[cs]e|psl) ?(?:v?2)?"),
        ("bigscience-rail", 0.9, ("bigscience",), r"bigscience (?:open )?rail(?: m)?(?: licen[cs]e)?"),
        ("openrail", 0.9, ("openrail",), r"(?:creativeml )?openrail(?: m)?(?: licen[cs]e)?"),
        ("llama", 0.9, ("llama",), r"llama \d(?: \d)? community licen[cs]e"),
        ("commons-clause", 0.9, ("commons clause",), r"commons clause(?: licen[cs]e)? condition"),
        ("proprietary", 0.5, ("proprietary",), r"proprietary and confidential"),
    ]
    return out


def _identifiers() -> list[Rule]:
    """``SPDX-License-Identifier`` lines: the words after it, as they are."""
    spelled = {
        "mit": "mit", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense", "bsl-1.0": "bsl 1 0", "0bsd": "0bsd", "bsd-2-clause": "bsd 2 clause", "bsd-3-clause": "bsd 3 clause",
        "cc0-1.0": "cc0 1 0", "ms-pl": "ms pl", "wtfpl": "wtfpl", "python-2.0": "python 2 0", "postgresql": "postgresql", "ncsa": "ncsa", "artistic-2.0": "artistic 2 0",
        "ofl-1.1": "ofl 1 1", "mpl-2.0": "mpl 2 0", "epl-2.0": "epl 2 0", "apache-2.0": "apache 2 0",
    }
    out = [(label, 1.0, ("spdx",), rf"spdx license identifier {words}") for label, words in spelled.items()]
    for kind in GNU:
        for n in NUMBERS[kind]:
            v = _name(n).replace(".", " ")
            out += [
                (f"{kind}-{_name(n)}-or-later", 1.0, ("spdx",), rf"spdx license identifier {kind} {v} or later"),
                (f"{kind}-{_name(n)}-only", 1.0, ("spdx",), rf"spdx license identifier {kind} {v}(?: only)?"),
            ]
    return out


RULES: list[Rule] = [*_identifiers(), *_texts(), *_gnu(), *_creative_commons(), *_titles()]
