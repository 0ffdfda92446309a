import sys

from hirelens.cli import main

sys.exit(main())
