SF_DIR = "/root/testdata/sf0.01"
