import sys

from larkspur.cli import main

sys.exit(main())
