"""python -m tempotrail"""

import sys

from tempotrail.jobs import main

sys.exit(main())
