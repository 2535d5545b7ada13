"""python -m sourcelens"""

import sys

from sourcelens.api.cli import main

sys.exit(main())
