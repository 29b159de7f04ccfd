"""Signature rules of the license scan, over normal text: lower-case words with single blanks.

A rule is (label, level, pattern); the pattern begins with a literal word, its keyword, and may
run over ``REACH`` words. Levels, from weak to strong: 1 a mention, 2 a name with its version,
3 a notice or tag, 4 a sentence of the license text itself. Rules are ordered: of equal detections
the earlier rule counts.
"""

from __future__ import annotations

import re

REACH = 26

#: Fixed: the base phrases and their labels.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

LIC = "(?:license|licence)"
V = "(?: version| v)? ?"

#: (label, names), every name a pattern.
NAMES = (
    ("apache-1.0", (f"apache (?:software )?{LIC}{V}1 0", "apache 1 0")),
    ("apache-1.1", (f"apache (?:software )?{LIC}{V}1 1", "apache 1 1")),
    ("apache-2.0", (f"apache (?:software )?{LIC}{V}2(?: 0)?", "apache 2(?: 0)?", "asl 2 0", f"al2 {LIC}")),
    ("mit", (f"mit {LIC}", f"mit x11 {LIC}", f"expat {LIC}", f"x11 {LIC}")),
    ("mit-0", ("mit 0", f"mit no attribution {LIC}")),
    ("bsd-2-clause", ("bsd 2 clause", "two clause bsd", f"simplified bsd {LIC}", f"freebsd {LIC}", "2 clause bsd")),
    ("bsd-3-clause", ("bsd 3 clause", "three clause bsd", "(?:new|modified|revised) bsd " + LIC, "3 clause bsd")),
    ("bsd-4-clause", ("bsd 4 clause", "four clause bsd", "original bsd " + LIC)),
    ("0bsd", ("0bsd", f"zero clause bsd {LIC}", f"bsd zero clause {LIC}")),
    ("isc", (f"isc {LIC}", f"internet systems consortium {LIC}")),
    ("gpl-1.0", (f"gnu general public {LIC}{V}1(?: 0)?", "gpl(?: v|v| )1(?: 0)?", f"general public {LIC}{V}1(?: 0)?")),
    ("gpl-2.0", (f"gnu general public {LIC}{V}2(?: 0)?", "gpl(?: v|v| )2(?: 0)?", f"general public {LIC}{V}2(?: 0)?")),
    ("gpl-3.0", (f"gnu general public {LIC}{V}3(?: 0)?", "gpl(?: v|v| )3(?: 0)?", f"general public {LIC}{V}3(?: 0)?")),
    ("lgpl-2.0", (f"gnu library general public {LIC}{V}2(?: 0)?", "lgpl(?: v|v| )2(?: 0)?")),
    ("lgpl-2.1", (f"gnu lesser general public {LIC}{V}2 1", "lgpl(?: v|v| )2 1", f"lesser general public {LIC}{V}2 1")),
    ("lgpl-3.0", (f"gnu lesser general public {LIC}{V}3(?: 0)?", "lgpl(?: v|v| )3(?: 0)?", f"lesser general public {LIC}{V}3(?: 0)?")),
    ("agpl-3.0", (f"gnu affero general public {LIC}{V}3(?: 0)?", "agpl(?: v|v| )3(?: 0)?", f"affero general public {LIC}{V}3(?: 0)?")),
    ("gfdl", (f"gnu free documentation {LIC}", "gfdl(?: 1 [123])?", "fdl 1 [123]")),
    ("mpl-1.1", (f"mozilla public {LIC}{V}1 1", "mpl(?: v|v| )1 1")),
    ("mpl-2.0", (f"mozilla public {LIC}{V}2(?: 0)?", "mpl(?: v|v| )2(?: 0)?")),
    ("epl-1.0", (f"eclipse public {LIC}{V}1(?: 0)?", "epl(?: v|v| )1(?: 0)?")),
    ("epl-2.0", (f"eclipse public {LIC}{V}2(?: 0)?", "epl(?: v|v| )2(?: 0)?")),
    ("cddl-1.0", (f"common development and distribution {LIC}", "cddl(?: 1 0)?")),
    ("cpl-1.0", (f"common public {LIC}", "cpl 1 0")),
    ("eupl", (f"european union public {LIC}", "eupl(?:(?: v|v| )1 [12])?")),
    ("artistic-1.0", (f"artistic {LIC}{V}1(?: 0)?", "artistic 1 0")),
    ("artistic-2.0", (f"artistic {LIC}{V}2(?: 0)?", "artistic 2 0")),
    ("bsl-1.0", (f"boost software {LIC}(?:{V}1 0)?", "bsl 1 0")),
    ("busl-1.1", (f"business source {LIC}(?:{V}1 1)?", "busl 1 1")),
    ("zlib", (f"zlib {LIC}", f"zlib libpng {LIC}")),
    ("libpng", (f"libpng {LIC}", f"png reference library {LIC}")),
    ("openssl", (f"openssl {LIC}", f"ssleay {LIC}")),
    ("postgresql", (f"postgresql {LIC}",)),
    ("python-2.0", (f"python software foundation {LIC}", f"psf {LIC}", f"python {LIC}")),
    ("ruby", (f"ruby {LIC}",)),
    ("php-3.01", (f"php {LIC}(?:{V}3 01)?",)),
    ("unlicense", ("unlicense",)),
    ("wtfpl", ("wtfpl", "fuck you want to public " + LIC)),
    ("cc0", ("cc0(?: 1 0)?", "creative commons zero(?: 1 0)?", "cc zero")),
    ("cc-by-2.0", ("cc by 2 0", "creative commons attribution 2 0")),
    ("cc-by-3.0", ("cc by 3 0", "creative commons attribution 3 0")),
    ("cc-by-4.0", ("cc by 4 0", "creative commons attribution 4 0")),
    ("cc-by-sa-3.0", ("cc by sa 3 0", "creative commons attribution share ?alike 3 0")),
    ("cc-by-sa-4.0", ("cc by sa 4 0", "creative commons attribution share ?alike 4 0")),
    ("cc-by-nc-3.0", ("cc by nc 3 0", "creative commons attribution non ?commercial 3 0")),
    ("cc-by-nc-4.0", ("cc by nc 4 0", "creative commons attribution non ?commercial 4 0")),
    ("cc-by-nd-4.0", ("cc by nd 4 0", "creative commons attribution no ?deriv(?:ative)?s 4 0")),
    ("cc-by-nc-sa-4.0", ("cc by nc sa 4 0", "creative commons attribution non ?commercial share ?alike 4 0")),
    ("cc-by-nc-nd-4.0", ("cc by nc nd 4 0", "creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0")),
    ("odbl-1.0", (f"open database {LIC}", "odbl(?: 1 0)?")),
    ("odc-by-1.0", (f"open data commons attribution {LIC}", "odc by(?: 1 0)?")),
    ("pddl-1.0", ("public domain dedication and " + LIC, "pddl(?: 1 0)?")),
    ("cdla-permissive", (f"community data {LIC} agreement permissive", "cdla permissive")),
    ("cdla-sharing", (f"community data {LIC} agreement sharing", "cdla sharing")),
    ("ofl-1.1", ("sil open font " + LIC, f"open font {LIC}", "ofl(?: 1 1)")),
    ("ms-pl", (f"microsoft public {LIC}", "ms pl")),
    ("ms-rl", (f"microsoft reciprocal {LIC}", "ms rl")),
    ("sspl-1.0", (f"server side public {LIC}", "sspl(?: v|v| )?1?")),
    ("elastic-2.0", (f"elastic {LIC}(?: 2 0)?",)),
    ("ncsa", (f"university of illinois ncsa open source {LIC}", f"ncsa {LIC}")),
    ("afl-3.0", (f"academic free {LIC}", "afl 3 0")),
    ("osl-3.0", (f"open software {LIC}", "osl 3 0")),
    ("ecl-2.0", (f"educational community {LIC}", "ecl 2 0")),
    ("upl-1.0", (f"universal permissive {LIC}", "upl 1 0")),
    ("cecill", (f"cecill(?: free software)?(?: {LIC})?(?: [bc])?",)),
    ("lppl", (f"latex project public {LIC}", "lppl(?: 1 3c?)?")),
    ("mulan-psl", (f"mulan permissive software {LIC}", "mulan psl(?: v2)?")),
    ("vim", (f"vim {LIC}",)),
    ("beerware", ("beerware", f"beer ware {LIC}")),
    ("openrail-m", ("openrail(?: m)?", f"responsible ai {LIC}s?", f"rail {LIC}")),
    ("llama-community", ("llama [0-9 ]*community " + LIC,)),
    ("gemma", (f"gemma (?:terms of use|{LIC})",)),
)

#: Notices around a name; ``{}`` stands for it.
THE = "(?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
NOTICES = (
    "(?:licensed|relicensed|released|distributed|available|published|offered|shared|covered|governed|subject|licence|license)"
    f" (?:under |by |to )?{THE}(?:{{}})",
    "(?:spdx) license identifier (?:{})",
)

#: Families without a version, and phrases that say what may be done.
MENTIONS = (
    ("gpl", "gnu gpl"), ("gpl", "gnu general public license"), ("gpl", "gpl licensed"),
    ("lgpl", "gnu lgpl"), ("lgpl", "gnu lesser general public license"), ("lgpl", "gnu library general public license"),
    ("agpl", "gnu agpl"), ("agpl", "gnu affero general public license"), ("apache", "apache license"),
    ("apache", "apache software license"), ("apache", "apache licensed"), ("bsd", f"bsd {LIC}"), ("bsd", "bsd style"),
    ("bsd", "bsd licensed"), ("mit", "mit licensed"), ("mit", "mit style license"), ("mpl", f"mozilla public {LIC}"),
    ("epl", f"eclipse public {LIC}"), ("artistic", f"artistic {LIC}"), ("cc-by-sa", "cc by sa"), ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"), ("cc-by-nc-sa", "cc by nc sa"), ("cc-by-nc-nd", "cc by nc nd"),
    ("cc", f"creative commons {LIC}"), ("cc-by", "creative commons attribution"),
    ("cc-by-sa", "creative commons attribution share ?alike"), ("cc-by-nc", "creative commons attribution non ?commercial"),
    ("public-domain", "public domain"), ("proprietary", "proprietary and confidential"),
    ("proprietary", "proprietary license"), ("proprietary", "confidential and proprietary"),
    ("proprietary", "unauthorized (?:copying|use|reproduction|distribution)"),
    ("proprietary", "commercial license"), ("proprietary", "end user license agreement"), ("proprietary", "eula"),
    ("permissive", "permissive license"), ("copyleft", "copyleft"), ("open-source", f"open source {LIC}"),
    ("free-software", f"free software {LIC}"), ("royalty-free", "royalty free license"),
    ("non-commercial", "non commercial use only"), ("non-commercial", "noncommercial use only"),
    ("research-only", "research use only"),
    ("research-only", "research purposes only"), ("evaluation-only", "evaluation purposes only"),
    ("reserved", "part of this (?:publication|book|document|work)"),
    ("copyright", "copyright (?:c |© )?[0-9]{4}"), ("copyright", "© [0-9]{4}"), ("copyright", "copyright notice"),
    ("copyright", "copyrighted (?:material|work)"), ("tdm-reserved", "text and data mining"),
    ("tdm-reserved", "tdm reservation"), ("no-ai", "used (?:to|for) train(?:ing)? (?:ai|models?|machine)"),
)

#: Sentences of the texts themselves.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "above copyright notice and this permission notice shall be included in all copies"),
    ("mit", "restriction including without limitation the rights to use copy modify merge publish"),
    ("mit", "software is provided as is without warranty of any kind express or implied"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", "redistributions of source code must retain the above copyright notice"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){1,6}nor the names of its contributors"),
    ("bsd-4-clause", "advertising materials mentioning features or use of this software must display"),
    ("bsd", "software is provided by the copyright holders and contributors as is"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file"),
    ("apache-2.0", "file except in compliance with the license"),
    ("apache-2.0", "applicable law or agreed to in writing software distributed under the license"),
    ("apache-2.0", "obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "terms and conditions for use reproduction and distribution"),
    ("gpl", "program is free software you can redistribute it and or modify it under the terms"),
    ("gpl", "program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "received a copy of the gnu general public license"),
    ("gpl-2.0-or-later", "either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "either version 3 of the license or at your option any later version"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("lgpl", "library is free software you can redistribute it and or modify it"),
    ("lgpl", "received a copy of the gnu lesser general public license"),
    ("agpl", "received a copy of the gnu affero general public license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free"),
    ("gfdl", "invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "source code form is subject to the terms of the mozilla public license"),
    ("mpl-1.1", "contents of this file are subject to the mozilla public license"),
    ("epl", "program and the accompanying materials are made available under the terms of the eclipse"),
    ("cddl-1.0", "contents of this file are subject to the terms of the common development and distribution"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("zlib", "software is provided as is without any express or implied warranty in no event"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "just do what the fuck you want to"),
    ("cc0", "extent possible under law the (?:author|person|affirmer)"),
    ("cc0", "waived all copyright and related or neighboring rights"),
    ("cc-by", "work is licensed under (?:a|the) creative commons attribution"),
    ("cc", "creative commons corporation is not a law firm and does not provide legal services"),
    ("cc-by", "free to share copy and redistribute the material in any medium or format"),
    ("cc-by-sa", "remix transform or build upon the material you must distribute your contributions under the same"),
    ("cc-by-nc", "material for commercial purposes"),
    ("cc-by-nd", "remix transform or build upon the material you may not distribute the modified material"),
    ("ofl-1.1", "font software is licensed under the sil open font license"),
    ("odbl-1.0", "made available under the open database license"),
    ("public-domain", "dedicated to the public domain"),
    ("public-domain", "released into the public domain"),
    ("public-domain", "work is in the public domain"),
    ("public-domain", "copyright is claimed by no one"),
    ("python-2.0", "psf is making python available to licensee on an as is basis"),
    ("ms-pl", "license governs use of the accompanying software"),
    ("artistic", "intent of this document is to state the conditions under which a package may be copied"),
    ("proprietary", "software is the confidential and proprietary information of"),
    ("proprietary", "part of this (?:publication|book|document|work) may be reproduced"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "(?:installing|downloading|using) this software you agree to be bound"),
    ("proprietary", "content on this (?:site|website|page) is protected by copyright"),
    ("research-only", "(?:dataset|data|model|corpus) is (?:made )?available for (?:non commercial )?research"),
    ("no-ai", "used to train (?:[^ ]+ ){0,3}(?:artificial intelligence|machine learning|language models?)"),
)


def rules() -> list[tuple[str, int, str]]:
    """All rules in their order, strongest level first."""
    out = [(label, 4, p) for label, p in SENTENCES]
    for label, names in NAMES:
        out += [(label, 3, notice.replace("{}", "|".join(names))) for notice in NOTICES]
    out += [(label, 2, name) for label, names in NAMES for name in names]
    out += [(label, 1, p) for label, p in MENTIONS]
    return out


def keywords(pattern: str) -> tuple[str, ...]:
    """The words a pattern can begin with: a literal word, a leading group of words, or a word whose
    version may be glued to it (gpl, gplv2)."""
    if pattern.startswith("(?:"):
        return tuple(pattern[3:pattern.index(")")].split("|"))
    word = re.match("[^ (?\\[]+", pattern).group()
    glued = ("v1", "v2", "v3") if pattern[len(word):].startswith("(?: v|v| )") else ()
    return (word, *[word + g for g in glued])
