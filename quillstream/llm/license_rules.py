"""Signature rules of the licence scan: ordered regexes over lower-case words that single spaces part.

A licence has a label, a keyword that its text must hold (or two parted by a bar: either one), its name as a regex, and its
identifier's words. Every alternative of a pattern must hold a keyword of its rule. Three forms
of each make three rules: an identifier tag (priority 1), a grant that names it (2), and the bare name (3). Terms that
name no licence follow with priority 4.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    #: A second keyword: where a text holds either, the rule is tried.
    other: str | None = None


GRANT = r"(?:licen[cs]ed|released|distributed|published|provided|available|covered|governed|redistributed|offered)(?: to you| for use| by| as is| only)? (?:under|by)(?: the)?(?: terms(?: and conditions)? of(?: the)?)? "
TAG = r"(?:spdx )?licen[cs]e(?: identifier| id)? "

#: label, keyword, name, identifier.
LICENCES = (
    ("mit", "mit|expat", r"(?:the )?(?:mit|expat)(?: x11)? licen[cs]e", r"mit"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?", r"mit 0"),
    ("x11", "x11", r"x11(?: style)? licen[cs]e", r"x11"),
    ("apache-1.0", "apache", r"apache(?: software)? licen[cs]e(?: version| v)? ?1 0", r"apache 1 0"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e(?: version| v)? ?1 1", r"apache 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?", r"apache 2 0"),
    ("bsd-1-clause", "bsd", r"(?:1|one) clause bsd(?: licen[cs]e)?", r"bsd 1 clause"),
    ("bsd-2-clause", "bsd", r"(?:(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:(?:4|four) clause bsd|original bsd|old bsd)(?: licen[cs]e)?", r"bsd 4 clause"),
    ("0bsd", "bsd", r"(?:zero|0) clause bsd(?: licen[cs]e)?", r"0bsd"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", r"bsd"),
    ("isc", "isc|internet systems", r"(?:isc|internet systems consortium) licen[cs]e", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib"),
    ("libpng", "libpng", r"libpng licen[cs]e(?: version 2)?", r"libpng(?: 2 0)?"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?: licen[cs]e)?", r"gpl"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?(?:version |v)?2(?: 0)?", r"gplv2"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?(?:version |v)?3(?: 0)?", r"gplv3"),
    ("lgpl-2.0", "library general", r"(?:gnu )?library general public licen[cs]e(?: version| v)? ?2(?: 0)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl ?(?:version |v)?(?:\d(?: \d)?)?(?: licen[cs]e)?", r"lgpl"),
    ("agpl-1.0", "affero", r"affero general public licen[cs]e(?: version| v)? ?1(?: 0)?", r"agpl 1 0(?: only| or later)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e(?:(?: version| v)? ?3(?: 0)?)?", r"agpl 3 0(?: only| or later)?"),
    ("agpl", "agpl", r"(?:gnu )?agpl ?(?:version |v)?(?:\d(?: \d)?)?", r"agpl"),
    ("gfdl-1.1", "free documentation", r"(?:gnu )?free documentation licen[cs]e(?: version)? 1 1", r"gfdl 1 1(?: only| or later)?"),
    ("gfdl-1.2", "free documentation", r"(?:gnu )?free documentation licen[cs]e(?: version)? 1 2", r"gfdl 1 2(?: only| or later)?"),
    ("gfdl-1.3", "free documentation", r"(?:gnu )?free documentation licen[cs]e(?: version)? 1 3", r"gfdl 1 3(?: only| or later)?"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", r"gfdl"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[cs]e(?: version| v)? ?1 0", r"mpl 1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e(?: version| v)? ?1 1", r"mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e(?:(?: version| v)? ?2 0)?", r"mpl 2 0"),
    ("npl-1.0", "netscape", r"netscape public licen[cs]e(?: version)? 1 0", r"npl 1 0"),
    ("npl-1.1", "netscape", r"netscape public licen[cs]e(?: version)? 1 1", r"npl 1 1"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e(?: version| v)? ?1 0", r"epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e(?:(?: version| v)? ?2 0)?", r"epl 2 0"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e(?: version| v)? ?1 0", r"edl 1 0"),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e(?: version)? 1 0", r"cddl 1 0"),
    ("cddl-1.1", "common development", r"common development and distribution licen[cs]e(?: version)? 1 1", r"cddl 1 1"),
    ("cpl-1.0", "common public", r"common public licen[cs]e(?: version)?(?: 1 0)?", r"cpl 1 0"),
    ("ipl-1.0", "ibm public", r"ibm public licen[cs]e(?: version)?(?: 1 0)?", r"ipl 1 0"),
    ("eupl-1.0", "european union", r"european union public licen[cs]e(?: version)? 1 0", r"eupl 1 0"),
    ("eupl-1.1", "european union", r"european union public licen[cs]e(?: version)? 1 1", r"eupl 1 1"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e(?:(?: version)? 1 2)?", r"eupl 1 2"),
    ("cecill-1.0", "cecill", r"cecill(?: free software)? licen[cs]e(?: agreement)?(?: version)? 1 0", r"cecill 1 0"),
    ("cecill-2.0", "cecill", r"cecill(?: free software)? licen[cs]e(?: agreement)?(?: version)? 2 0", r"cecill 2 0"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)? licen[cs]e(?: agreement)?(?: version)? 2 1", r"cecill 2 1"),
    ("cecill-b", "cecill", r"cecill b licen[cs]e", r"cecill b"),
    ("cecill-c", "cecill", r"cecill c licen[cs]e", r"cecill c"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e(?: version)? 1 0", r"artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e(?: version)? 2 0", r"artistic 2 0"),
    ("artistic", "artistic", r"artistic licen[cs]e", r"artistic"),
    ("perl", "perl", r"same terms as perl(?: itself)?", r"perl"),
    ("psf-2.0", "python|psf", r"python software foundation licen[cs]e(?: version 2)?", r"(?:psf|python) 2 0"),
    ("ruby", "ruby", r"ruby licen[cs]e", r"ruby"),
    ("php-3.0", "php", r"php licen[cs]e(?: version)? 3 0", r"php 3 0"),
    ("php-3.01", "php", r"php licen[cs]e(?: version)? 3 01", r"php 3 01"),
    ("zpl-2.0", "zope", r"zope public licen[cs]e(?: version)? 2 0", r"zpl 2 0"),
    ("zpl-2.1", "zope", r"zope public licen[cs]e(?: version)? 2 1", r"zpl 2 1"),
    ("w3c", "w3c", r"w3c software(?: notice)?(?: and)?(?: document)? licen[cs]e", r"w3c"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version 2)?", r"wtfpl"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?:(?: version)? 1 0)?", r"bsl 1 0"),
    ("beerware", "beer", r"beer ?ware licen[cs]e", r"beerware"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl"),
    ("ssleay", "ssleay", r"(?:original )?ssleay licen[cs]e", r"ssleay"),
    ("curl", "curl", r"curl licen[cs]e", r"curl"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", r"ncsa"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql"),
    ("mulan-psl-2.0", "mulan", r"mulan (?:permissive software licen[cs]e|psl)(?: v2| version 2)?", r"mulanpsl 2 0"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", r"ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", r"ms rl"),
    ("osl-1.0", "open software", r"open software licen[cs]e(?: version| v)? ?1 0", r"osl 1 0"),
    ("osl-2.1", "open software", r"open software licen[cs]e(?: version| v)? ?2 1", r"osl 2 1"),
    ("osl-3.0", "open software", r"open software licen[cs]e(?: version| v)? ?3 0", r"osl 3 0"),
    ("afl-2.1", "academic free", r"academic free licen[cs]e(?: version| v)? ?2 1", r"afl 2 1"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e(?: version| v)? ?3 0", r"afl 3 0"),
    ("qpl-1.0", "public", r"q public licen[cs]e(?: version)?(?: 1 0)?", r"qpl 1 0"),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e", r"sleepycat"),
    ("vim", "vim", r"vim licen[cs]e", r"vim"),
    ("wxwindows", "wxwindows", r"wxwindows(?: library)? licen[cs]e", r"wxwindows"),
    ("json", "json", r"json licen[cs]e", r"json"),
    ("icu", "icu", r"icu licen[cs]e", r"icu"),
    ("unicode-dfs-2016", "unicode", r"unicode(?: data files and software)? licen[cs]e(?: agreement)?", r"unicode dfs 2016"),
    ("hpnd", "historical", r"historical permission notice and disclaimer", r"hpnd"),
    ("ntp", "ntp", r"ntp licen[cs]e", r"ntp"),
    ("tcl", "tcl", r"tcl tk licen[cs]e", r"tcl"),
    ("ofl-1.0", "font", r"(?:sil )?open font licen[cs]e(?: version)? 1 0", r"ofl 1 0"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e(?:(?: version)? 1 1)?", r"ofl 1 1"),
    ("ubuntu-font-1.0", "font", r"ubuntu font licen[cs]e(?: version)?(?: 1 0)?", r"ubuntu font 1 0"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database licen[cs]e(?: v1 0| version 1 0)?", r"odbl 1 0"),
    ("odc-by-1.0", "data commons", r"open data commons attribution licen[cs]e(?: v1 0| version 1 0)?", r"odc by 1 0"),
    ("pddl-1.0", "domain dedication", r"(?:open data commons )?public domain dedication and licen[cs]e", r"pddl 1 0"),
    ("cdla-permissive-2.0", "community data", r"community data licen[cs]e agreement permissive(?: version)?(?: 2 0)?", r"cdla permissive 2 0"),
    ("cdla-sharing-1.0", "community data", r"community data licen[cs]e agreement sharing(?: version)?(?: 1 0)?", r"cdla sharing 1 0"),
    ("ogl-uk-3.0", "open government", r"open government licen[cs]e(?: v3 0| version 3 0)?", r"ogl uk 3 0"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc0-1.0", "creative commons zero", r"creative commons zero(?: v1 0| 1 0)?(?: universal)?", r"creative commons zero"),
    ("busl-1.1", "business source", r"business source licen[cs]e(?:(?: version)? 1 1)?", r"busl 1 1"),
    ("sspl-1.0", "server side", r"server side public licen[cs]e(?:(?: version| v)? ?1(?: 0)?)?", r"sspl 1 0"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?:(?: version)? 2 0)?", r"elastic 2 0"),
    ("commons-clause", "commons clause", r"commons clause(?: licen[cs]e)?(?: condition)?(?: v1 0)?", r"commons clause"),
    ("polyform-noncommercial-1.0.0", "polyform", r"polyform noncommercial licen[cs]e(?: 1 0 0)?", r"polyform noncommercial 1 0 0"),
    ("polyform-small-business-1.0.0", "polyform", r"polyform small business licen[cs]e(?: 1 0 0)?", r"polyform small business 1 0 0"),
    ("openrail-m", "rail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[cs]e)?", r"openrail(?: m)?"),
    ("llama-community", "llama", r"llama(?: \d(?: \d)?)? community licen[cs]e(?: agreement)?", r"llama\d"),
    ("gemma", "gemma", r"gemma terms of use", r"gemma"),
)

#: The six licences of a creative commons suite: label, words of the name, words of the identifier.
CREATIVE = (
    ("cc-by", r"attribution", r"by"),
    ("cc-by-sa", r"attribution share ?alike", r"by sa"),
    ("cc-by-nd", r"attribution no ?deriv(?:ative)?s?(?: works)?", r"by nd"),
    ("cc-by-nc", r"attribution non ?commercial", r"by nc"),
    ("cc-by-nc-sa", r"attribution non ?commercial share ?alike", r"by nc sa"),
    ("cc-by-nc-nd", r"attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?", r"by nc nd"),
)
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Terms that name no licence.
TERMS = (
    Rule("all-rights-reserved", "rights reserved", r"all rights reserved", 4),
    Rule("public-domain", "public domain", r"(?:placed|released|dedicated|is)(?: in| into| to)? the public domain", 4),
    Rule("non-commercial", "commercial", r"(?:for )?non ?commercial (?:use|purposes)(?: only)?", 4),
    Rule("no-redistribution", "redistribut", r"(?:may not be redistributed|redistribution is prohibited)", 4),
    Rule("permissive-grant", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 4),
    Rule("bsd-grant", "redistribution and use", r"redistribution and use in source and binary forms", 4),
    Rule("as-is", "as is", r"provided as is without(?: any)? warranty", 4),
    Rule("proprietary", "proprietary", r"proprietary and confidential", 4),
    Rule("copyleft", "copyleft", r"copyleft", 4),
)


def rules() -> list[Rule]:
    """All rules in order."""
    out = []
    for label, keyword, name, ident in LICENCES:
        keyword, _, other = keyword.partition("|")
        word, other = ident.split(" ")[0].split("(")[0].rstrip("\\d"), other or None
        out += [Rule(label, word or keyword, TAG + ident, 1, None if word else other), Rule(label, keyword, GRANT + name, 2, other), Rule(label, keyword, name, 3, other)]
    for label, name, ident in CREATIVE:
        for version in VERSIONS:
            v = version.replace(".", " ")
            out += [
                Rule(f"{label}-{version}", "cc " + ident, rf"(?:{TAG}|{GRANT})?cc {ident} {v}", 1),
                Rule(f"{label}-{version}", "creativecommons org licenses", rf"creativecommons org licenses {ident} {v}", 1),
                Rule(f"{label}-{version}", "creative commons", rf"(?:{GRANT})?creative commons {name} {v}(?: (?:international|unported|generic))?(?: (?:public )?licen[cs]e)?", 2),
            ]
        out += [Rule(label, "creative commons", rf"(?:{GRANT})?creative commons {name}(?: licen[cs]e)?", 3), Rule(label, "cc " + ident, rf"(?:{TAG}|{GRANT})?cc {ident}(?: licen[cs]e)?", 3)]
    return [*out, *TERMS]


#: What a text must hold before any rule is tried: every keyword above stands beside one of these, or holds it.
GATE = r"(?i)licen[cs]e|general[^a-z0-9]+public|gpl|public[^a-z0-9]+domain|creative|rights[^a-z0-9]+reserved|copyleft|unlicense|wtfpl|cc0|(?<![a-z0-9])cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by|redistribut|non[^a-z0-9]*commercial|hereby[^a-z0-9]+granted|proprietary|as[^a-z0-9]+is[^a-z0-9]+without|commons|open[^a-z0-9]*rail|mulan|no[^a-z0-9]+attribution|bsd|terms|disclaimer"
