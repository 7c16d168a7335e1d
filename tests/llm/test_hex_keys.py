"""Keys in hex digits of either case."""

import random
import struct

from canopy.llm import secret_scan
from tests.llm.test_llm import der


def test_hex_keys_of_either_case():
    rng = random.Random(9)
    ssh = b"".join(struct.pack(">I", len(f)) + f for f in (b"ssh-ed25519", rng.randbytes(32)))
    key = der(0x30, der(2, b"\1" + rng.randbytes(64)) + der(2, b"\1\0\1"))
    for data in (ssh, key):
        low = data.hex()
        mixed = "".join(rng.choice([c, c.upper()]) for c in low)
        for text in (low, low.upper(), mixed):
            found = secret_scan.scan(f"see {text} end")
            assert [f for f in found if f[2] == "key"] == [(4, 4 + len(text), "key")]
            assert secret_scan.redact(f"see {text} end", found) == "see [secret] end"
        assert [f for f in secret_scan.scan(f"see A{low} end") if f[2] == "key"] == [(5, 5 + len(low), "key")]
        assert not [f for f in secret_scan.scan(f"see {low.upper()[:-2]} end") if f[2] == "key"]
