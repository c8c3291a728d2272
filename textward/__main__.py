import sys

from textward.service import main

sys.exit(main())
