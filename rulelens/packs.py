"""Our own rule packs for prose, web pages and chats, and an overlay. All are plain rule records."""

from rulelens.sources.rules import Pack, rules_from_records

_PROSE = ["src*/*.txt"]


def _rule(rule_id, name, level, globs, regexes, tags, why, do, fix=""):
    return {
        "id": rule_id,
        "name": name,
        "level": level,
        "category": rule_id.split("/")[0],
        "description": why,
        "checklist": do,
        "fix": fix or do[0],
        "tags": tags,
        "triggers": {"file_patterns": globs, "code_patterns": regexes},
    }


PROSE = Pack(
    "prose",
    tuple(
        rules_from_records(
            [
                _rule(
                    "privacy/email", "E-mail address in text", "critical", _PROSE,
                    [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z][A-Za-z]+"],
                    ["privacy", "pii"], "An address identifies a person.", ["Mask the address"],
                ),
                _rule(
                    "privacy/long-number", "Card-like number in text", "major", _PROSE, [r"[0-9]{16}"],
                    ["privacy", "pii", "payment"], "Sixteen digits in a row look like a card.", ["Mask the number"],
                ),
                _rule(
                    "privacy/phone", "Phone number in text", "minor", _PROSE, [r"\+[0-9]+ \([0-9]{3}\)"],
                    ["privacy", "pii"], "A number identifies a person.", ["Mask the number"],
                ),
                _rule(
                    "privacy/ip-address", "Network address in text", "minor", _PROSE,
                    [r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"],
                    ["privacy"], "An address can identify a device.", ["Mask the address"],
                ),
                _rule(
                    "security/hardcoded-token", "Secret token in text", "blocker", _PROSE,
                    [r'token = "[0-9a-f]{40}"', r"secret_key *="],
                    ["security", "secret"], "A token grants access to whoever reads it.", ["Revoke it", "Remove it"],
                ),
                _rule(
                    "legal/license-line", "License notice in text", "info", _PROSE,
                    [r"Released under the [A-Z]+ License", r"[Cc]opyright"],
                    ["legal"], "A notice may bind the reuse of the text.", ["Check the terms"],
                ),
                _rule(
                    "tone/insult", "Insulting word", "major", _PROSE, [r"worthless"],
                    ["tone"], "The word belittles a reader.", ["Rephrase"],
                ),
                _rule(
                    "quality/symbol-junk", "Runs of symbols", "minor", _PROSE, [r"[#$%&*]{3}"],
                    ["quality"], "Symbol runs are left over from broken markup.", ["Strip the symbols"],
                ),
                _rule(
                    "quality/table-row", "Row of a flattened table", "info", _PROSE, [r" \| [^|]+ \| "],
                    ["quality"], "A table without markup reads badly.", ["Restore the table"],
                ),
                _rule(
                    "language/second-reader", "Spanish text of the second tier", "info", ["src1*/es/*"], [],
                    ["language"], "These sources need a second reader.", ["Ask a second reader"],
                ),
            ],
            "prose",
        )
    ),
    "1.0.0",
    "Prose documents",
)

WEB = Pack(
    "web",
    tuple(
        rules_from_records(
            [
                _rule(
                    "html/inline-script", "Inline script", "major", ["web/*.html"], [r"<script>"],
                    ["html", "security"], "Inline code defeats a content policy.", ["Move it to a file"],
                ),
                _rule(
                    "html/tracking-call", "Tracking call", "critical", ["web/*.html"], [r"track\([0-9]+\)"],
                    ["html", "privacy"], "The page reports visits.", ["Ask for consent"],
                ),
                _rule(
                    "html/ad-block", "Advertisement block", "minor", ["web/*.html"], [r'class="ad"'],
                    ["html"], "Advertisements are not content.", ["Drop the block"],
                ),
                _rule(
                    "html/script-link", "Script in a link", "blocker", ["web/*.html"], [r'href="javascript:'],
                    ["html", "security"], "The link runs code.", ["Use a plain link"],
                ),
                _rule(
                    "html/french-host", "French section", "info", ["web/*/fr/*"], [],
                    ["html", "language"], "The section has its own editor.", ["Route to the editor"],
                ),
            ],
            "web",
        )
    ),
    "1.1.0",
    "Crawled web pages",
)

CHAT = Pack(
    "chat",
    tuple(
        rules_from_records(
            [
                _rule(
                    "chat/short-turn", "Very short turn", "minor", ["chat/*"], [r"\A[^\n]{0,40}\Z"],
                    ["chat"], "A turn this short carries little.", ["Drop the turn"],
                ),
                _rule(
                    "chat/system-turn", "System turn in the data", "major", ["chat/*.system"], [],
                    ["chat"], "Instructions are not dialogue.", ["Move it out"],
                ),
                _rule(
                    "general/reviewed", "Applies to everything", "info", [], [],
                    ["general"], "Every row is looked at.", ["Look at it"],
                ),
            ],
            "chat",
        )
    ),
    description="Conversations",
)

# An overlay: the house treats phone numbers as more severe than the prose pack does.
HOUSE = Pack(
    "house",
    tuple(
        rules_from_records(
            [
                _rule(
                    "privacy/phone", "Phone number in text", "major", _PROSE, [r"\+[0-9]+ \([0-9]{3}\)"],
                    ["privacy", "pii", "house"], "A number identifies a person.", ["Mask the number"],
                )
            ],
            "house",
        )
    ),
)

PACKS = [PROSE, WEB, CHAT]
