import sys

from tarn.engine import main

sys.exit(main(sys.argv[1:]))
