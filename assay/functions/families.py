"""Classes of verdict family strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category words. A string made only of these names no particular family.
GENERIC_WORDS = """
generic gen heur heuristic heuristics suspicious suspect unsafe malware malicious malicious_confidence
agent variant artemis unknown w32 win32 win64 w64 pe trojan trj virus worm packed packer pack
crypt cryptor obfuscated obfus score ml ai behavior behaveslike behaves like exe dll file high
medium low confidence detection downloader dropper backdoor ransom ransomware stealer spy
spyware injector rootkit exploit adload bundle multi msil win html script js vbs macro
""".split()
# Words of potentially unwanted programs, and of tools with a legitimate use.
PUP_WORDS = (
    "pup pua adware riskware unwanted grayware greyware potentially bundler toolbar optional".split()
)
DUAL_USE_WORDS = (
    "hacktool hktl remoteadmin remote admintool pentest mimikatz psexec netcat nmap "
    "metasploit cobaltstrike cobalt"
).split()

CLASSES = ("none", "pup", "dual_use", "specific", "generic")


def clean_family(family: Column) -> Column:
    """Lower case, without surrounding whitespace of any kind; NULL becomes the empty string."""
    trimmed = F.regexp_replace(F.regexp_replace(family, r"^\s+", ""), r"\s+$", "")
    return F.coalesce(F.lower(trimmed), F.lit(""))


def words(family: Column) -> Column:
    """The lower-case alphanumeric runs of a family string."""
    return F.regexp_extract_all(F.lower(family), F.lit("([a-z0-9]+)"), F.lit(1))


def _one_of(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def family_class(family: Column) -> Column:
    """none, pup, dual_use, specific or generic: the first that holds, in that order.

    A specific family is a word of four letters or more that is not a category word.
    """
    tokens = words(family)
    names = F.filter(tokens, lambda t: F.length(t).__ge__(4) & t.rlike("^[a-z]+$"))
    return (
        F.when(clean_family(family) == "", "none")
        .when(F.arrays_overlap(tokens, _one_of(PUP_WORDS)), "pup")
        .when(F.arrays_overlap(tokens, _one_of(DUAL_USE_WORDS)), "dual_use")
        .when(F.size(F.array_except(names, _one_of(GENERIC_WORDS))) > 0, "specific")
        .otherwise("generic")
    )
