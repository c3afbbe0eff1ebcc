"""Small trace documents, written by hand, one for each shape that the pattern library must tell apart."""

import json

SENDER, OTHER = "0x" + "aa" * 20, "0x" + "bb" * 20
VICTIM, HELPER, LIBRARY = "0x" + "c1" * 20, "0x" + "c2" * 20, "0x" + "c3" * 20
TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"


def word(n: int) -> str:
    return f"0x{n:064x}"


def topic(address: str) -> str:
    return "0x" + "0" * 24 + address[2:]


def write(contract: str, slot: int = 0, before: int = 0, after: int = 1) -> dict:
    return {"contract": contract, "slot": word(slot), "before": word(before), "after": word(after)}


def log(address: str, topics: list[str], data: str, index: int = 0) -> dict:
    return {"address": address, "topics": topics, "data": data, "logIndex": hex(index)}


def call(kind: str, frm: str, to: str | None, *calls: dict, ok: bool = True, value: int = 0, writes=(), logs=(), data: str | None = None) -> dict:
    out = {"kind": kind, "from": frm, "to": to, "value": hex(value), "gasLimit": "0x5208", "gasUsed": "0x100", "succeeded": ok}
    out |= {"storageChanges": list(writes), "logs": list(logs), "calls": list(calls)}
    return out | ({"input": data} if data is not None else {})


def document(root: dict, status: str = "success", number: int = 1) -> dict:
    tx = {"hash": word(number), "from": SENDER, "to": root["to"], "value": "0x0", "nonce": "0x1", "gasUsed": "0x5208", "status": status}
    return {"transaction": tx, "block": {"number": "0x10", "timestamp": "0x20", "chainId": "0x1", "baseFee": None}, "root": root}


def text(root: dict, **kw) -> str:
    return json.dumps(document(root, **kw))


def _destroy(frm: str, to: str, ok: bool = True) -> dict:
    return call("selfdestruct", frm, to, ok=ok)


_SENT = [TRANSFER, topic(OTHER), topic(SENDER)]

#: name -> (document text, the findings expected of the whole library: pattern -> statuses)
CORPUS = {
    "reentrancy": (
        text(call("call", SENDER, VICTIM, call("call", VICTIM, HELPER, call("call", SENDER, VICTIM, writes=[write(VICTIM)])))),
        {"classic_reentrancy": ["grounded"], "delegatecall_storage_collision": []},
    ),
    "reentrancy_no_way_back": (text(call("call", SENDER, VICTIM, call("call", VICTIM, HELPER, call("call", HELPER, LIBRARY, writes=[write(LIBRARY)])))), {}),
    "write_before_reentry": (text(call("call", SENDER, VICTIM, call("call", VICTIM, HELPER, call("call", SENDER, VICTIM)), writes=[write(VICTIM)])), {}),
    "price": (
        text(call("call", SENDER, VICTIM, logs=[log(LIBRARY, _SENT, word(5))], writes=[write(VICTIM, 7)])),
        {"oracle_manipulation": ["abstain"]},
    ),
    "unchecked": (text(call("call", SENDER, VICTIM, call("call", VICTIM, HELPER, ok=False), writes=[write(VICTIM, 1)])), {"unchecked_external_call": ["grounded"]}),
    "checked": (text(call("call", SENDER, VICTIM, call("call", VICTIM, HELPER, ok=False), ok=False), status="reverted"), {}),
    "collision": (text(call("call", SENDER, VICTIM, call("delegatecall", VICTIM, LIBRARY, writes=[write(VICTIM, 0)]))), {"delegatecall_storage_collision": ["grounded"]}),
    "collision_other_slot": (text(call("call", SENDER, VICTIM, call("delegatecall", VICTIM, LIBRARY, writes=[write(VICTIM, 9)]))), {}),
    "collision_sibling": (text(call("call", SENDER, VICTIM, call("delegatecall", VICTIM, LIBRARY), call("call", VICTIM, HELPER, writes=[write(HELPER, 0)]))), {}),
    "destroyed": (text(call("call", SENDER, VICTIM, _destroy(VICTIM, SENDER))), {"unsafe_selfdestruct": ["grounded"]}),
    "destroy_reverted": (text(call("call", SENDER, VICTIM, _destroy(VICTIM, SENDER, ok=False), ok=False), status="reverted"), {}),
    "destroyed_by_library": (
        text(call("call", SENDER, VICTIM, call("delegatecall", VICTIM, LIBRARY, _destroy(VICTIM, SENDER)))),
        {"unsafe_selfdestruct": ["grounded"], "delegatecall_reachable_selfdestruct": ["grounded"], "delegatecall_reachable_selfdestruct_transitive": ["grounded"]},
    ),
    "destroyed_below_library": (
        text(call("call", SENDER, VICTIM, call("delegatecall", VICTIM, LIBRARY, call("call", VICTIM, HELPER, _destroy(HELPER, SENDER))))),
        {"unsafe_selfdestruct": ["grounded"], "delegatecall_reachable_selfdestruct_transitive": ["grounded"]},
    ),
    "destroyed_beside_library": (
        text(call("call", SENDER, VICTIM, call("delegatecall", VICTIM, LIBRARY), call("call", VICTIM, HELPER, _destroy(HELPER, SENDER)))),
        {"unsafe_selfdestruct": ["grounded"]},
    ),
    "spoofed": (text(call("call", SENDER, VICTIM, logs=[log(VICTIM, [*_SENT, word(1)], "0x")])), {"spoofed_transfer_event": ["grounded"]}),
    "spoofed_amount": (text(call("call", SENDER, VICTIM, logs=[log(VICTIM, _SENT, word(1 << 200))])), {"spoofed_transfer_event": ["grounded"]}),
    "real_transfer": (text(call("call", SENDER, VICTIM, logs=[log(VICTIM, _SENT, word(5))])), {}),
}
