"""Graded passages: prose written for this package, each at a stated school year (14 and more: beyond school).

A year stands for what readers of it are commonly given: one-clause sentences of everyday words in the first
years, linked clauses and subject words in the middle ones, abstract nouns and nested clauses at its end, the
register of scholarship and law beyond. The years were set when the passages were written, not computed.
"""

PASSAGES: list[tuple[float, str]] = [
    (1.0, "The cat is on the mat. It is a big cat. The cat can run. Sam has a red ball. He will throw it. The cat sees the ball. It runs and jumps. Sam laughs. The cat is fun. Mom comes in. She has milk. The cat likes milk. Now the cat is full. It naps in the sun. Sam sits by the cat. He is glad."),
    (1.5, "We went to the farm. I saw a pig and a cow. The pig was in the mud. The cow ate hay. A hen sat on an egg. Dad let me feed the goats. They took the corn out of my hand. It felt wet and I had to giggle. We rode on a cart. Then it was time to go home. I want to go back soon."),
    (2.0, "Tom got a new bike for his birthday. It was blue and had a bell. At first he fell off the bike a lot. His sister held the seat and ran with him. After lunch he tried again. This time she let go and he did not fall. He rode all the way to the gate. Tom rang the bell and waved at his sister. She clapped her hands."),
    (2.5, "It rained all night. In the morning the yard was full of puddles. Ana put on her boots and her yellow coat. She found a worm on the path. The worm was long and pink. She picked it up and put it back on the grass. A bird looked at the worm too. Ana told the bird to find some seeds. Then she ran inside to get dry socks and a hot drink."),
    (3.0, "Bees live together in a hive. Each hive has one queen. The queen lays all the eggs. The other bees do many jobs. Some of them clean the hive and some look after the young bees. Others fly out to find flowers. When a bee finds good flowers, it goes home and does a little dance. The dance tells the other bees where to fly. They bring back sweet juice and make honey from it."),
    (3.5, "Long ago a poor man found a small pot in his field. He put one coin in the pot. The next day there were two coins in it. He put in an apple, and soon he had two apples. The man was happy and shared his food with the whole village. But a greedy neighbor stole the pot at night. He leaned over too far and fell in. In the morning there were two greedy neighbors, and they shouted at each other all day."),
    (4.0, "A desert is a place that gets very little rain. The days can be hot, but the nights are often cold. Plants in the desert have ways to save water. A cactus keeps water inside its thick stem. Its sharp spines keep thirsty animals away. Many desert animals sleep in the shade during the day. They come out when the sun goes down and the air is cool. Some of them never need to drink, because they get water from the food they eat."),
    (4.5, "Our class planted a garden behind the school this spring. First we pulled up the weeds and mixed good soil into the ground. Each group picked one kind of seed. My group chose beans, since they grow fast. We made a small sign so that nobody would step on them. After ten days we could see the first green leaves. When the plants grew tall, we tied them to sticks. In June we picked so many beans that everyone could take some home."),
    (5.0, "Before there were trains, people crossed the country in wagons pulled by oxen. The trip took about five months. A family had to carry all of its food, tools and clothes, so there was no room to ride. Most people walked beside the wagon. Rivers were the most dangerous part, because the water could carry a wagon away. At night the drivers put the wagons in a circle. The children gathered wood while the adults cooked and looked after the animals."),
    (5.5, "Sound is made when something moves back and forth very quickly. When you pluck a string on a guitar, you can see it shake. The string pushes the air around it, and that push travels through the room until it reaches your ear. A short, tight string shakes faster than a long, loose one, so its sound is higher. If there were no air, the push would have nothing to travel through. That is why there is no sound in space."),
    (6.0, "Volcanoes form where melted rock rises through cracks in the crust of the earth. Some of them erupt gently, and the hot lava flows down the sides like thick syrup. Others explode because gas is trapped inside the rock. When an explosion happens, ash can rise high into the sky and drift for hundreds of miles. Although the ash can bury farms and towns, it also makes the soil rich. For this reason many people choose to live near volcanoes even though they know the danger."),
    (7.5, "The printing press changed the way people shared information. Before it was invented, every book had to be copied by hand, which could take a single writer more than a year. Because books were so expensive, only wealthy families and churches owned them. The press used small metal letters that could be arranged into pages, covered with ink and used again. Within fifty years, millions of books had been printed, and ordinary people began to read news and ideas from distant countries."),
    (8.0, "During photosynthesis, green plants use energy from sunlight to turn carbon dioxide and water into sugar. The process takes place inside tiny structures called chloroplasts, which contain the pigment that gives leaves their color. Oxygen is released as a waste product, and animals depend on it to breathe. When there is less light, the process becomes slower, and the plant has to rely on the sugar that it stored earlier. Farmers can therefore increase their harvest by controlling the temperature and the light in a greenhouse."),
    (8.5, "My grandmother rarely talked about the year she spent on the island, but she kept a small wooden box that nobody was allowed to open. When she finally gave it to me, I expected jewelry or old letters. Instead there was a handful of sand, a rusted key and a photograph of a house I did not recognize. It took me several weeks to discover where the picture had been taken, and even longer to understand why she had never returned to the place that she still dreamed about."),
    (9.0, "When the server receives a request, it first checks whether the user has permission to read the document. If the check succeeds, the document is loaded from the cache, and the database is only contacted when the cache does not contain a recent copy. This design reduces the number of slow operations, but it also means that a change can remain invisible for several seconds. Developers who need the newest version can disable the cache for a single request by adding an option to the address."),
    (9.5, "Supply and demand determine the price of most products in a market. If many customers want a product and only a few companies sell it, the price will usually rise until some customers decide that it is too expensive. A higher price encourages other companies to produce the same thing, which increases the supply and slowly reduces the price again. Governments sometimes interfere with this process by setting a maximum price, but such limits often cause shortages because producers lose the motivation to sell."),
    (10.0, "The configuration file describes which services are started and in what order they depend on each other. When a service cannot connect to its database, the manager waits for a short interval before it tries again, and after five attempts it reports the failure to the administrator. Previous versions restarted every service whenever a single connection was lost, which created unnecessary traffic on the network. The current release restarts only the affected service, so the remaining parts of the application continue to respond while the problem is being corrected."),
    (10.5, "Many historians argue that the invention of the steam engine alone cannot explain why industry developed first in certain regions. Cheap coal, reliable transport and a growing population were equally important, and none of them would have been sufficient without investors who were willing to risk their money. Workers left the countryside because agriculture offered fewer opportunities, while the new factories promised regular wages. Living conditions in the crowded cities were often terrible, however, and it took decades before parliament introduced laws that protected the health of children and adults."),
    (11.0, "Antibiotics have saved countless lives, yet their success has created a new problem. Whenever bacteria are exposed to a drug, the few individuals that happen to resist it survive and reproduce, and the resistant form gradually becomes more common. Doctors who prescribe antibiotics for infections caused by viruses, against which the drugs have no effect, accelerate this development without helping the patient. Researchers are therefore looking for alternative treatments, but pharmaceutical companies hesitate to invest in medicines that will deliberately be used as rarely as possible."),
    (11.5, "The novel presents its narrator as a respectable citizen, but careful readers soon notice that his account contradicts itself. He insists that he never visited the victim, although he describes the furniture of her apartment in considerable detail. By allowing the character to reveal more than he intends, the author creates a tension between what is said and what actually happened. The technique also raises the question of whether any description of the past can be trusted, since every witness selects some facts and ignores others according to personal interest."),
    (12.0, "Democratic institutions depend on the assumption that citizens can form an opinion on the basis of reliable information. When the sources of information become fragmented, different groups no longer disagree merely about values but about the facts themselves, and political compromise becomes considerably more difficult. Some observers recommend stricter regulation of digital platforms, while others emphasize that education offers better protection in the long term. Both positions have advantages, but neither provides a simple solution, because restrictions on false statements can easily be extended to legitimate criticism of the government."),
    (12.5, "In statistics, a correlation between two variables does not necessarily indicate that one of them causes the other. Both may be influenced by a third factor that was not included in the investigation, or the relationship may simply be a coincidence that disappears when additional observations are collected. Experiments attempt to eliminate these alternatives by assigning participants randomly to different conditions, so that any systematic difference between the groups can be attributed to the treatment. Where experiments would be impossible or unethical, researchers must rely on natural variation and on explicit assumptions about its origin."),
    (14.0, "Contemporary theories of institutional change have increasingly abandoned the presumption that organizations respond rationally to environmental pressures, emphasizing instead the interpretive processes through which such pressures are constructed as relevant in the first place. Organizational actors do not merely encounter uncertainty; they participate in its production by privileging particular categories of information over others. Consequently, apparently identical regulatory interventions may generate divergent outcomes, depending on the cognitive frameworks and the distribution of professional authority within the organizations to which they are addressed."),
    (14.5, "The pharmacological inhibition of the enzyme produced a substantial attenuation of the inflammatory response, although the magnitude of the effect varied considerably with the genetic background of the experimental population. Subsequent characterization of the underlying signaling pathway demonstrated that the compound interferes with receptor internalization rather than with ligand binding, which contradicts the mechanism proposed in earlier investigations. These observations necessitate a reevaluation of the therapeutic potential of related compounds, particularly in patients whose immunological competence is already compromised by concomitant medication."),
    (15.0, "Notwithstanding any provision of this agreement to the contrary, the indemnifying party shall not be liable for consequential or incidental damages arising out of the performance or nonperformance of its contractual obligations, except insofar as such damages are attributable to gross negligence or intentional misconduct. The limitation of liability established herein shall be construed in accordance with the applicable jurisdiction and shall survive the termination or expiration of this agreement, irrespective of whether the circumstances occasioning such termination were reasonably foreseeable by either of the contracting parties at the commencement of their relationship."),
    (15.5, "The epistemological difficulty inherent in any retrospective interpretation of revolutionary consciousness consists precisely in the impossibility of disentangling the participants' self-understanding from the historiographical categories by which that understanding has subsequently been rendered intelligible. Insofar as the archive itself constitutes the sedimentation of administrative priorities, the presumption of documentary transparency must be relinquished in favor of a methodology that interrogates the conditions of archival production, thereby acknowledging that the absence of testimony may be considerably more significant than its ostensible abundance."),
    (16.0, "A comprehensive formalization of distributed consensus presupposes an unambiguous characterization of the synchrony assumptions under which termination is guaranteed, since the impossibility of deterministic agreement in asynchronous environments precludes any unconditional formulation of liveness. Probabilistic termination, whereby the expected number of communication rounds remains bounded notwithstanding adversarial scheduling, accordingly constitutes a theoretically satisfactory compromise, although its practical implementation necessitates cryptographic primitives whose computational requirements substantially exceed those of conventional authentication infrastructure and whose correctness depends upon comparatively unverifiable assumptions."),
    (16.5, "Whereas the phenomenological tradition conceives of intentionality as an irreducible characteristic of conscious experience, representationalist accounts endeavor to reconstruct it in terms of the functional organization of subpersonal information processing, thereby presupposing the very normativity whose naturalization they purport to accomplish. The resulting indeterminacy of representational content, far from constituting a merely terminological inconvenience, jeopardizes the explanatory legitimacy of the entire enterprise, inasmuch as the individuation of psychological states remains contingent upon interpretive considerations that are themselves constitutively intentional and consequently unavailable to a reductive characterization."),
]
