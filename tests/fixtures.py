"""Small log texts used as golden fixtures (see FIXTURES.md section 2).

FIXED VALUES: inputs that the golden results depend on, value for value.
"""

OOM_LOG = """\
24/03/02 08:14:01 INFO SparkContext: Running Spark version 3.4.1
24/03/02 08:14:02 INFO SparkContext: Submitted application: customer_daily_agg
24/03/02 08:16:44 WARN TaskSetManager: Lost task 14.2 in stage 3.0
24/03/02 08:16:45 ERROR YarnClusterScheduler: Lost executor 7 on node-04: Container killed by YARN for exceeding memory limits. 16.5 GB of 16 GB physical memory used.
java.lang.OutOfMemoryError: GC overhead limit exceeded
\tat org.apache.spark.sql.execution.SparkPlan.executeQuery(SparkPlan.scala:155)
24/03/02 08:16:46 ERROR DAGScheduler: Stage 3 failed after 4 attempts
"""

S3_LOG = """\
24/03/02 09:02:01 INFO SparkContext: Running Spark version 3.3.2 on EMR 6.15
com.amazonaws.services.s3.model.AmazonS3Exception: Access Denied (Service: Amazon S3; Status Code: 403)
\tat com.amazonaws.http.AmazonHttpClient.handleErrorResponse(AmazonHttpClient.java:1819)
24/03/02 09:05:23 ERROR FileFormatWriter: Job aborted due to stage failure
"""

KAFKA_LOG = """\
24/03/02 09:21:00 INFO SparkContext: Running Spark Structured Streaming 3.4.2 on Databricks
org.apache.kafka.common.errors.TimeoutException: Topic 'user-events-prod' not present in metadata after 60000 ms
\tat org.apache.kafka.clients.consumer.KafkaConsumer.partitionsFor(KafkaConsumer.java:1900)
"""

SHUFFLE_LOG = """\
24/03/02 10:00:00 INFO SparkContext: Running Spark version 3.5.0 on Kubernetes
24/03/02 10:05:00 ERROR ShuffleBlockFetcherIterator: Failed to fetch shuffle block
org.apache.spark.shuffle.FetchFailedException: Failed to connect to executor after 3 retries
24/03/02 10:05:01 WARN TaskSetManager: Lost executor 3 on spark-worker-pod-7
"""

CLEAN_LOG = """\
24/03/02 07:00:00 INFO SparkContext: Running Spark version 3.4.1
24/03/02 07:01:00 INFO DAGScheduler: Job 0 finished in 45.2 s
24/03/02 07:01:01 INFO SparkContext: Successfully stopped SparkContext
"""

DEMO_OOM = """\
24/03/02 08:14:01 INFO SparkContext: Running Spark version 3.4.1
24/03/02 08:14:02 INFO SparkContext: Submitted application: customer_daily_agg
24/03/02 08:16:44 WARN TaskSetManager: Lost task 14.2 in stage 3.0
24/03/02 08:16:45 ERROR YarnClusterScheduler: Lost executor 7 on node-04.prod: Container killed by YARN for exceeding memory limits. 16.5 GB of 16 GB physical memory used.
24/03/02 08:16:45 ERROR SparkUncaughtExceptionHandler: Uncaught exception in thread Thread[Executor task launch worker-14,5,main]
java.lang.OutOfMemoryError: GC overhead limit exceeded
\tat org.apache.spark.sql.execution.SparkPlan.executeQuery(SparkPlan.scala:155)
\tat org.apache.spark.sql.execution.exchange.ShuffleExchangeExec.execute(ShuffleExchangeExec.scala:119)
24/03/02 08:16:46 ERROR DAGScheduler: Stage 3 (toPandas at job.py:87) failed after 4 attempts
24/03/02 08:16:46 ERROR SparkContext: Error initializing SparkContext.
"""

DEMO_S3 = """\
24/03/02 09:02:01 INFO SparkContext: Running Spark version 3.3.2 on EMR 6.15
24/03/02 09:02:10 INFO: Platform: Amazon EMR
24/03/02 09:05:22 ERROR S3NativeFileSystem: Failed to read s3://prod-data-lake/features/v2/date=2026-03-02/
com.amazonaws.services.s3.model.AmazonS3Exception: Access Denied (Service: Amazon S3; Status Code: 403; Error Code: AccessDenied)
\tat com.amazonaws.http.AmazonHttpClient$RequestExecutor.handleErrorResponse(AmazonHttpClient.java:1819)
24/03/02 09:05:23 ERROR FileFormatWriter: Job aborted due to stage failure: Task 0 in stage 1.0 failed
24/03/02 09:05:23 ERROR SparkContext: Error in DAGScheduler.runJob()
"""

DEMO_KAFKA = """\
24/03/02 09:21:00 INFO SparkContext: Running Spark Structured Streaming 3.4.2 on Databricks
24/03/02 09:21:05 WARN KafkaDataConsumer: KafkaDataConsumer is not running in UninterruptibleThread
24/03/02 09:21:44 ERROR MicroBatchExecution: Query [id = abc123] terminated with error
org.apache.kafka.common.errors.TimeoutException: Topic 'user-events-prod' not present in metadata after 60000 ms
\tat org.apache.kafka.clients.consumer.KafkaConsumer.partitionsFor(KafkaConsumer.java:1900)
24/03/02 09:21:45 ERROR StreamExecution: Query failed: user_events_streaming
"""

# (job, text, lines, err, warn, version, platform, stages, lost, oom, shuffle, retries,
#  signals [(label, hits)], stack frames per signal)
GOLDEN = [
    ("oom", OOM_LOG, 7, 2, 1, "3.4.1", "yarn", ["3"], 1, 1, 0, 0,
     [("OOM/Memory", 2), ("TaskFailure", 1)], [1, 0]),
    ("s3", S3_LOG, 4, 1, 0, "3.3.2", "emr", [], 0, 0, 0, 0,
     [("StorageAccess", 1), ("TaskFailure", 1)], [1, 0]),
    ("kafka", KAFKA_LOG, 3, 0, 0, "unknown", "databricks", [], 0, 0, 0, 0,
     [("NetworkTimeout", 1)], [1]),
    ("shuffle", SHUFFLE_LOG, 4, 1, 1, "3.5.0", "kubernetes", [], 1, 0, 2, 0,
     [("ShuffleFetch", 2), ("ExecutorLost", 1)], [0, 0]),
    ("clean", CLEAN_LOG, 3, 0, 0, "3.4.1", "unknown", [], 0, 0, 0, 0, [], []),
    ("multi", OOM_LOG + "\n" + SHUFFLE_LOG, 11, 3, 2, "3.4.1", "yarn", ["3"], 2, 1, 2, 0,
     [("OOM/Memory", 2), ("TaskFailure", 1), ("ShuffleFetch", 2), ("ExecutorLost", 1)], [1, 0, 0, 0]),
    ("demo_oom", DEMO_OOM, 10, 4, 1, "3.4.1", "yarn", [], 1, 1, 0, 0,
     [("OOM/Memory", 2), ("DriverCrash", 1), ("TaskFailure", 1)], [2, 0, 0]),
    ("demo_s3", DEMO_S3, 7, 3, 0, "3.3.2", "emr", [], 0, 0, 0, 0,
     [("DriverCrash", 1), ("StorageAccess", 1), ("TaskFailure", 1)], [0, 1, 0]),
    ("demo_kafka", DEMO_KAFKA, 6, 2, 1, "unknown", "databricks", [], 0, 0, 0, 0,
     [("NetworkTimeout", 1)], [1]),
]

FILE_GOLDEN = {
    "oom_sample": (19, 4, 2, "3.4.1", "yarn", [], 2, 1, 0, 0,
                   [("OOM/Memory", 3), ("DriverCrash", 1), ("ExecutorLost", 1), ("TaskFailure", 1)],
                   [3, 0, 3, 0]),
    "s3_access_denied": (12, 3, 1, "3.3.2", "emr", [], 0, 0, 0, 0,
                         [("DriverCrash", 1), ("StorageAccess", 1), ("TaskFailure", 2), ("Retry", 1)],
                         [1, 2, 1, 2]),
    "kafka_timeout": (10, 2, 1, "unknown", "databricks", [], 0, 0, 0, 0,
                      [("NetworkTimeout", 1)], [2]),
}
