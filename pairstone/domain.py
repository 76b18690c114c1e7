"""Closed domains of the engine's columns. Values are the strings that tables hold, so a member may stand in any expression."""

from __future__ import annotations

from enum import StrEnum


class Side(StrEnum):
    DONOR = "D"
    RECIPIENT = "R"


class Status(StrEnum):
    RESOLVED = "RESOLVED"
    REVIEW_REQUIRED = "REVIEW_REQUIRED"
    UNKNOWN = "UNKNOWN"
    NOT_TESTED = "NOT_TESTED"
    ABSENT = "ABSENT"


class Typing(StrEnum):
    ABSENT = "ABSENT"
    ONE = "ONE"
    BOTH = "BOTH"
    REVIEW_REQUIRED = "REVIEW_REQUIRED"


class Presence(StrEnum):
    PRESENT = "PRESENT"
    ABSENT = "ABSENT"
    UNKNOWN = "UNKNOWN"
    REVIEW_REQUIRED = "REVIEW_REQUIRED"


class Gate(StrEnum):
    COMPATIBLE = "COMPATIBLE"
    INCOMPATIBLE = "INCOMPATIBLE"
    UNKNOWN = "UNKNOWN"


class Route(StrEnum):
    FACT = "fact"
    CONFLICT = "conflict"
    REVIEW = "review"
    UNKNOWN = "unknown"


class Outcome(StrEnum):
    CORRECT = "CORRECT"
    PARTIAL = "PARTIAL"
    FALSE_ACCEPTANCE = "FALSE_ACCEPTANCE"
    MISSED = "MISSED"
    CORRECT_ABSTENTION = "CORRECT_ABSTENTION"


class Tier(StrEnum):
    A = "A"
    B = "B"
    C = "C"


class RowKind(StrEnum):
    MESSAGE = "MESSAGE"
    SERVICE = "SERVICE"
    UNPARSED = "UNPARSED"
