"""Places outside the repository."""

import os

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("SPANFORGE_TOKENIZERS", "/opt/tokenizers")
