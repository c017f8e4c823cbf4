"""Prompt texts of the 5G signalling task."""

from __future__ import annotations

# Prompt formats; "{log}" marks the place of the log text.
INSTRUCTION_PROMPT = (
    "### Instruction\n"
    "Analyze the following 3GPP signaling log and identify the root cause.\n"
    "\n"
    "### Log\n"
    "{log}\n"
    "\n"
    "### Root Cause\n"
)
CHAT_SYSTEM = (
    "You are a 3GPP root cause analysis assistant. Given a signaling log, respond with ONLY a JSON array of root "
    "cause labels. Valid labels: core_network_failure, authentication_failure, normal, handover_failure, congestion, "
    'qos_violation, transport_jitter, radio_failure. Example: ["congestion"]'
)
CHAT_PROMPT = (
    "<|im_start|>system\n"
    "{system}<|im_end|>\n"
    "<|im_start|>user\n"
    "{log}<|im_end|>\n"
    "<|im_start|>assistant\n"
)
CHAT_END = "<|im_end|>"
NO_REASONING = "\n/no_think"
CHAT_MODELS = ("Qwen/Qwen3-14B",)
REASONING_SUFFIX = "\n\nThink step by step, then output the JSON array."
HOSTED_SYSTEM = (
    "You are a 5G core network expert. Analyze 3GPP signaling logs and identify the root cause. Respond with ONLY a "
    "JSON array containing one label from: [core_network_failure, authentication_failure, normal, handover_failure, "
    "congestion, qos_violation, transport_jitter, radio_failure]"
)

# What a generated log should show, per label.
SCENARIOS = {
    "core_network_failure": (
        "Generate a synthetic 3GPP NAS/NGAP signaling log for a 5G SA core showing a UPF degradation cascade failure. "
        "The AMF loses N11 interface to SMF, PDU sessions drop. Include sympathetic noise: heartbeat timeouts, "
        "keepalive retries, spurious PFCP session modification attempts."
    ),
    "authentication_failure": (
        "Generate a synthetic 3GPP NAS signaling log showing a 5G AKA authentication failure. UE sends Registration "
        "Request, AMF triggers Authentication Request, UE responds with wrong RES*, AMF sends Authentication Reject "
        "(cause 21). Include retries and sympathetic noise: duplicate NAS messages, timer T3560 expiry."
    ),
    "normal": (
        "Generate a synthetic 3GPP NAS/NGAP/RRC signaling log showing a completely successful 5G SA registration and "
        "PDU session establishment. UE attaches, authenticates, gets IP, data flows normally. Include normal "
        "keepalives and periodic TAU."
    ),
    "handover_failure": (
        "Generate a synthetic 3GPP NGAP/Xn signaling log showing an Xn-based handover failure between two gNBs. "
        "Handover Request is sent but target gNB responds with Handover Failure (cause: radio-network / "
        "no-radio-resources-available). Include sympathetic noise: RRC measurement reports, A3 event triggers."
    ),
    "congestion": (
        "Generate a synthetic 3GPP NAS/NGAP signaling log showing AMF overload / congestion. AMF sends Overload Start "
        "with reduction percentage. UEs receive Registration Reject cause #22 (congestion). Include sympathetic noise: "
        "back-off timer T3346, repeated registration attempts."
    ),
    "qos_violation": (
        "Generate a synthetic 3GPP NAS/NGAP/N4 signaling log showing a QoS policy violation. SMF installs a GBR QoS "
        "flow but UPF reports the guaranteed bitrate cannot be met. PCF triggers policy update. Include sympathetic "
        "noise: PFCP session modification, N1 PDU Session Modification Command."
    ),
    "transport_jitter": (
        "Generate a synthetic 3GPP F1/NG/Xn interface log showing high transport jitter between gNB-DU and gNB-CU "
        "causing PDCP reordering timeouts and RLC retransmissions. Include sympathetic noise: HARQ NACK bursts, RLC "
        "status PDUs, spurious RRC RRCReconfiguration."
    ),
    "radio_failure": (
        "Generate a synthetic 3GPP RRC/NGAP signaling log showing radio link failure (RLF). UE detects T310 expiry, "
        "sends RRC Setup Request after RLF. gNB triggers UE Context Release. Include sympathetic noise: CQI "
        "degradation reports, beam failure recovery attempts, spurious measurement reports."
    ),
}

# The output contract that follows the scenario.
GENERATION_CONTRACT = (
    "{scenario}\n"
    "\n"
    "Output ONLY a valid JSON object on a single line with exactly two keys:\n"
    '- "log": a realistic multi-line 3GPP signaling log string (use \\n for newlines), 150-300 words\n'
    '- "root_cause": a JSON array containing exactly one string from this list: {labels}\n'
    "\n"
    'The root_cause array must contain: ["{label}"]\n'
    "\n"
    'Example format: {"log": "2024-01-15 10:23:41.123 [AMF] ...", "root_cause": ["{label}"]}\n'
    "\n"
    "Respond with ONLY the JSON object, no explanation, no markdown."
)
