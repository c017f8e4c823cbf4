"""Label vocabularies: the data that parameterises extraction and scoring."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Vocabulary:
    """What counts as an answer.

    ``labels`` is an ordered list: its order decides which label is primary when
    a text names several. ``synonyms`` is an ordered list of (regex, label).
    Labels are compared in lower case and noise codes in upper case, so both are
    folded here once.
    """

    labels: tuple[str, ...]
    default: str
    noise: tuple[str, ...] = ()
    synonyms: tuple[tuple[str, str], ...] = field(default=())

    def __post_init__(self) -> None:
        object.__setattr__(self, "labels", tuple(dict.fromkeys(x.lower() for x in self.labels)))
        object.__setattr__(self, "noise", tuple(dict.fromkeys(x.upper() for x in self.noise)))
        object.__setattr__(self, "synonyms", tuple(tuple(s) for s in self.synonyms))

    @property
    def noise_hides_labels(self) -> bool:
        """True when a noise code is also spelled like a label (the noise test then decides)."""
        return any(label.upper() in self.noise for label in self.labels)

    @property
    def labels_look_like_json_scalars(self) -> bool:
        """True when a label could be read from a JSON number or literal, such as ``1`` or ``true``."""

        def is_json(text: str) -> bool:
            try:
                json.loads(text)
            except ValueError:
                return False
            return True

        return any(is_json(label) for label in self.labels)

    def usable(self, label: str) -> str | None:
        """The canonical form of one code, or None when the noise filter would drop it."""
        code = label.strip()
        if code.upper() in self.noise or code.lower() not in self.labels:
            return None
        return code.lower()

    def synonym_groups(self) -> list[tuple[str, list[str]]]:
        """Neighbouring patterns of one label, in table order: [(label, [pattern, ...]), ...]."""
        groups: list[tuple[str, list[str]]] = []
        for pattern, label in self.synonyms:
            if groups and groups[-1][0] == label:
                groups[-1][1].append(pattern)
            else:
                groups.append((label, [pattern]))
        return groups


# The labels, noise codes and ordered phrase patterns of the 5G signalling task.
SIGNALLING = Vocabulary(
    labels=(
        "core_network_failure",
        "authentication_failure",
        "normal",
        "handover_failure",
        "congestion",
        "qos_violation",
        "transport_jitter",
        "radio_failure",
    ),
    default="normal",
    noise=(
        "HEARTBEAT_TIMEOUT",
        "KEEPALIVE_FAIL",
        "KEEPALIVE_TIMEOUT",
        "SECONDARY_ALARM",
        "CASCADING_FAILURE",
        "PFCP_HEARTBEAT_TIMEOUT",
        "N2_HEARTBEAT_TIMEOUT",
        "N11_HEARTBEAT_TIMEOUT",
        "TIMER_EXPIRY",
        "RETRANSMISSION",
        "DUPLICATE_NAS",
        "SPURIOUS_MEASUREMENT",
        "BEAM_FAILURE_RECOVERY",
        "RLC_RETRANSMISSION",
        "HARQ_NACK",
    ),
    synonyms=(
        (r"authentication\s+fail", "authentication_failure"),
        (r"auth\s+fail", "authentication_failure"),
        (r"auth\s+reject", "authentication_failure"),
        (r"incorrect.*res\*", "authentication_failure"),
        (r"invalid.*res\*", "authentication_failure"),
        (r"cause\s+(value\s+)?21", "authentication_failure"),
        (r"failed\s+authentication", "authentication_failure"),
        (r"handover\s+fail", "handover_failure"),
        (r"handover\s+reject", "handover_failure"),
        (r"ho\s+fail", "handover_failure"),
        (r"insufficient\s+radio\s+resources", "handover_failure"),
        (r"target\s+gnb.*not\s+have\s+sufficient", "handover_failure"),
        (r"handover\s+preparation\s+fail", "handover_failure"),
        (r"congestion", "congestion"),
        (r"overload", "congestion"),
        (r"cause\s+(value\s+)?22", "congestion"),
        (r"qos\s+violation", "qos_violation"),
        (r"qos\s+flow.*fail", "qos_violation"),
        (r"guaranteed\s+bit\s*rate.*not.*supported", "qos_violation"),
        (r"cannot\s+meet.*guaranteed\s+bitrate", "qos_violation"),
        (r"gbr.*not.*supported", "qos_violation"),
        (r"qos\s+flow\s+installation\s+fail", "qos_violation"),
        (r"qos\s+parameters.*adjust", "qos_violation"),
        (r"transport.?jitter", "transport_jitter"),
        (r"reordering\s+timeout", "transport_jitter"),
        (r"pdcp.*retransmission", "transport_jitter"),
        (r"pdcp.*reordering", "transport_jitter"),
        (r"missing\s+pdcp\s+pdu", "transport_jitter"),
        (r"transmission\s+error", "transport_jitter"),
        (r"jitter", "transport_jitter"),
        (r"radio\s+link\s+failure", "radio_failure"),
        (r"radio\s+failure", "radio_failure"),
        (r"rlf", "radio_failure"),
        (r"beam\s+failure(?!\s+recovery)", "radio_failure"),
        (r"rsrp.*weak", "radio_failure"),
        (r"weak\s+rsrp", "radio_failure"),
        (r"cqi\s+degradation", "radio_failure"),
        (r"radio\s+conditions", "radio_failure"),
        (r"core\s+network\s+failure", "core_network_failure"),
        (r"n3\s+interface.*fail", "core_network_failure"),
        (r"pfcp\s+session.*fail", "core_network_failure"),
        (r"smf.*fail", "core_network_failure"),
        (r"amf.*fail(?!.*auth)", "core_network_failure"),
        (r"upf.*fail", "core_network_failure"),
        (r"n2\s+interface.*fail", "core_network_failure"),
        (r"core.*network.*down", "core_network_failure"),
    ),
)
