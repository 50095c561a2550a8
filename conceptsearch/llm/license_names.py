"""Names of licences as notices write them, and SPDX identifiers.

Names are normalised as sentences are: lower case, words of letters and
digits.  The tables are plain data; ``license_scan`` looks names up in them.
"""

from __future__ import annotations

from itertools import product


def _gnu() -> dict[str, str]:
    """GNU licences: full names and short ones, with versions and without later ones."""
    kinds = {"GPL": ("general", ("1.0", "2.0", "3.0")), "AGPL": ("affero general", ("3.0",)),
             "LGPL": ("lesser general", ("2.0", "2.1", "3.0")), "GFDL": ("free documentation", ("1.1", "1.2", "1.3"))}
    later = {"": "", " only": "", " or later": "-or-later", " or any later version": "-or-later",
             " or at your option any later version": "-or-later", " or newer": "-or-later"}
    out = {}
    for short, (words, versions) in kinds.items():
        full = f"{words} license" if short == "GFDL" else f"{words} public license"
        names = [full, f"gnu {full}", short.lower(), f"gnu {short.lower()}"]
        for version in versions:
            spoken = version.replace(".", " ")
            forms = [spoken, *([spoken[:-2]] if spoken.endswith(" 0") else [])]
            for name, form, mark, (suffix, add) in product(names, forms, (" ", " v", " version ", " v ", "v"), later.items()):
                if mark == "v" and not name.endswith(short.lower()):
                    continue
                for end in ("", " license"):
                    out[f"{name}{mark}{form}{suffix}{end}"] = f"{short}-{version}{add}"
    return out


def _creative_commons() -> dict[str, str]:
    parts = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
    spelt = {"sharealike": "share alike", "noncommercial": "non commercial", "noderivatives": "no derivatives"}
    out = {}
    for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        full = " ".join(parts[p] for p in kind.split())
        apart = " ".join(spelt.get(parts[p], parts[p]) for p in kind.split())
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            spoken = version.replace(".", " ")
            name = f"CC-{kind.upper().replace(' ', '-')}-{version}"
            for words, place, end in product((f"cc {kind}", f"creative commons {kind}", f"creative commons {full}",
                                              f"creative commons {apart}"), ("", " international", " unported", " generic"),
                                             ("", " license", " licence")):
                out[f"{words} {spoken}{place}{end}"] = name
                out[f"{words}{end} {spoken}{place}"] = name
    return out


def _others() -> dict[str, str]:
    versioned = {
        "Apache": (("apache license", "apache software license", "apache"), ("1.1", "2.0")),
        "MPL": (("mozilla public license", "mpl"), ("1.0", "1.1", "2.0")),
        "EPL": (("eclipse public license", "epl"), ("1.0", "2.0")),
        "CDDL": (("common development and distribution license", "cddl"), ("1.0", "1.1")),
        "EUPL": (("european union public licence", "european union public license", "eupl"), ("1.0", "1.1", "1.2")),
        "BSL": (("boost software license", "boost"), ("1.0",)), "Artistic": (("artistic license", "artistic"), ("1.0", "2.0")),
        "OFL": (("sil open font license", "open font license", "ofl"), ("1.0", "1.1")),
        "ODbL": (("open database license", "odbl"), ("1.0",)), "PSF": (("python software foundation license", "psf license"), ("2.0",)),
        "AFL": (("academic free license",), ("2.1", "3.0")), "OSL": (("open software license",), ("2.1", "3.0")),
        "UPL": (("universal permissive license",), ("1.0",)), "ZPL": (("zope public license",), ("2.0", "2.1")),
        "CPL": (("common public license",), ("1.0",)), "CC0": (("cc0", "creative commons zero", "creative commons cc0"), ("1.0",)),
    }
    out = {}
    for short, (names, versions) in versioned.items():
        for version in versions:
            spoken = version.replace(".", " ")
            forms = [spoken, *([spoken[:-2]] if version == "2.0" else [])]
            for name, form, mark, end in product(names, forms, (" ", " v", " version ", " v "),
                                                 ("", " license", " universal", " universal license")):
                out[f"{name}{mark}{form}{end}"] = f"{short}-{version}"
    plain = {
        "MIT": ("mit", "mit license", "mit licence", "expat license", "mit expat license", "x11 mit license"),
        "ISC": ("isc", "isc license", "isc licence"), "Unlicense": ("unlicense", "unlicense license"),
        "BSD-2-Clause": ("bsd 2 clause", "bsd 2 clause license", "2 clause bsd license", "two clause bsd license",
                         "simplified bsd license", "freebsd license", "bsd 2 clause simplified license"),
        "BSD-3-Clause": ("bsd 3 clause", "bsd 3 clause license", "3 clause bsd license", "three clause bsd license",
                         "new bsd license", "modified bsd license", "revised bsd license", "bsd 3 clause new or revised license"),
        "BSD-4-Clause": ("bsd 4 clause license", "4 clause bsd license", "original bsd license"),
        "0BSD": ("0bsd", "zero clause bsd license", "bsd zero clause license"), "Zlib": ("zlib license", "zlib"),
        "WTFPL": ("wtfpl", "wtfpl license", "do what the fuck you want to public license"),
        "PostgreSQL": ("postgresql license",), "OpenSSL": ("openssl license",), "NCSA": ("university of illinois ncsa open source license",),
        "Beerware": ("beerware license", "beer ware license"), "MS-PL": ("microsoft public license", "ms pl"),
        "MS-RL": ("microsoft reciprocal license", "ms rl"), "Ruby": ("ruby license",), "X11": ("x11 license",),
    }
    out |= {alias: name for name, aliases in plain.items() for alias in aliases}
    return out


#: Normalised name to licence.
NAMES = _gnu() | _creative_commons() | _others()

#: SPDX identifiers without a digit or hyphen; others are told by their form.
SPDX_WORDS = """MIT ISC Zlib Unlicense WTFPL curl Beerware PostgreSQL OpenSSL Ruby Vim NTP Intel JSON HPND Sendmail SISSL SMLNJ
IJG Libpng libtiff NCSA Naumen Newsletr Noweb Plexus psutils Qhull Rdisc RSCPL SCEA Sleepycat TCL TMate Xerox XSkat xpp Zed
Glide Giftware gnuplot eGenix diffmark DOC dvipdfm CrystalStacker Cube Borceux Barr Bahyph Afmparse AMDPLPA AML AMPAS ADSL
Abstyles Aladdin APAFML Entessa Eurosym Fair FreeImage FTL FSFUL FSFULLR HaskellReport iMatix ImageMagick Jam Leptonica
MakeIndex Motosoto MTLL Multics Mup MITNFA NLPL Nokia NRL OGTSL OML SNIA SWL VOSTROM W3C Wsuipa xinetd MirOS Nunit Saxpath
blessing bzip2 Caldera CATOSL ClArtistic Condor Dotseqn DSDP EUDatagrid Frameworx GLWTPL Interbase IPA JasPer NGPL NOSL Python
SugarCRM Spencer TOSL UCAR Watcom xlock Linux""".split()
#: Lower-cased identifier to its own spelling, for the commonest.
SPDX_SPELT = {name.lower(): name for name in (*SPDX_WORDS, *set(NAMES.values()), "X11", "0BSD", "BSL-1.0", "MIT-0", "AFL-3.0")}
