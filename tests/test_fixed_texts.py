"""The oracle renders prompts from the engine's own templates, so a slip in a
template would not show there: fixed texts are held by their digests."""
import hashlib
import json

import pytest

from findings_lake.operators import prompts
from findings_lake.sources import wordlists

DIGESTS = {
    "SYSTEM_PROMPT": "a210fcee9a486702",
    "SCAN_TEMPLATE": "e32c90d97f88302b",
    "MITIGATION_SYSTEM_PROMPT": "d6464219f9dacbb5",
    "MITIGATION_TEMPLATE": "10ac970f7e440627",
    "wordlists": "d46097e9c4cf1d4a"
}


@pytest.mark.parametrize("name", sorted(DIGESTS))
def test_fixed_text(name):
    text = json.dumps(wordlists.DEFAULT_WORDLIST_MAP) if name == "wordlists" else str(getattr(prompts, name))
    assert hashlib.sha256(text.encode()).hexdigest()[:16] == DIGESTS[name]
